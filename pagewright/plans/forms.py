"""Form fields. The tree of fields is region - nation - customer - order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fields as O
from ..operators import trees
from .registry import Book, table

book = Book()

_NODES = """(SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS part, CASE WHEN r_regionkey % 2 = 0 THEN 'Tx' END AS type FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Ch' END FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'Btn' END FROM customer)"""


def nodes(spark, sf_dir) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), text("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("part"), F.when(F.col("r_regionkey") % 2 == 0, "Tx").alias("type"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey")), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "Ch"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), text("c_custkey")), F.concat(F.lit("n"), text("c_nationkey")), F.when(F.col("c_custkey") % 5 != 0, text("c_custkey")).otherwise(""), F.when(F.col("c_custkey") % 7 == 0, "Btn"))
    return r.union(n).union(c)


_WALK = f"""WITH RECURSIVE t AS (SELECT * FROM {_NODES}), w AS (SELECT node, parent, part AS name, type AS kind, 0 AS depth FROM t WHERE parent IS NULL
    UNION ALL SELECT t.node, t.parent, CASE WHEN t.part <> '' AND w.name <> '' THEN w.name || '.' || t.part WHEN t.part <> '' THEN t.part ELSE w.name END, coalesce(t.type, w.kind), w.depth + 1 FROM t JOIN w ON t.parent = w.node)"""


@book.query(f"{_WALK} SELECT node, name, kind, CAST(depth AS INTEGER) AS depth FROM w")
def c12_field_names(spark, sf_dir):
    return trees.field_names(nodes(spark, sf_dir)).select("node", "name", "kind", "depth")


@book.query(f"{_WALK} SELECT node, name FROM w WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
def c13_terminal_fields(spark, sf_dir):
    df = nodes(spark, sf_dir)
    return trees.terminals(df, trees.field_names(df)).select("node", "name")


@book.query(f"{_WALK} SELECT node, name FROM w WHERE node LIKE 'c%' AND depth = 2")
def c14_full_name(spark, sf_dir):
    return trees.field_names(nodes(spark, sf_dir)).where("node LIKE 'c%' AND depth = 2").select("node", "name")


@book.query(f"{_WALK} SELECT min(node) AS node FROM w WHERE name = (SELECT name FROM w WHERE node = 'c1')")
def c15_find_by_name(spark, sf_dir):
    named = trees.field_names(nodes(spark, sf_dir))
    wanted = named.where("node = 'c1'").select("name")
    return named.join(F.broadcast(wanted), "name", "left_semi").agg(F.min("node").alias("node"))


@book.query(f"{_WALK} SELECT node, kind AS value FROM w")
def c20_inherited_type(spark, sf_dir):
    return trees.inherited(nodes(spark, sf_dir), "type")


@book.query(f"{_WALK} SELECT w.node, coalesce(CASE WHEN node LIKE 'c%' THEN (SELECT c_nationkey % 4 * 90 FROM customer WHERE 'c' || c_custkey = w.node AND c_custkey % 3 = 0) END, 0)::INTEGER AS rotate FROM w")
def c17_inherited_rotate(spark, sf_dir):
    """A rotation that only some leaves have; none above them, so the default is 0."""
    own = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (F.col("c_nationkey") % 4 * 90).cast("int").alias("rotate"))
    df = nodes(spark, sf_dir).join(own, "node", "left")
    return trees.inherited(df, "rotate").select("node", F.coalesce("value", F.lit(0)).alias("rotate"))


_BOXES = "WITH b AS (SELECT c_custkey AS page, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS own, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10.0::DOUBLE END AS above, r_regionkey * 100.0::DOUBLE AS root FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _boxes(spark, sf_dir, key: str):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") * 100.0).alias(key))
    n = table(spark, sf_dir, "nation").select(text("n", "n_nationkey"), text("r", "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") * 10.0))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), text("n", "c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")))
    found = trees.inherited(r.union(n).union(c), key)
    return found.where(F.col("node").rlike("^[0-9]")).select(F.col("node").cast("long").alias("page"), "value")


@book.query(f"{_BOXES} SELECT page, coalesce(own, above, root) AS value FROM b")
def c16_inherited_rect(spark, sf_dir):
    return _boxes(spark, sf_dir, "crop_box")


@book.query(f"{_BOXES} SELECT page, coalesce(own, above, root) AS value FROM b")
def c19_inherited_media_box(spark, sf_dir):
    return _boxes(spark, sf_dir, "media_box")


@book.query(f"{_WALK.replace('coalesce(t.type, w.kind)', 'coalesce(t.type || t.part, w.kind)').replace('type AS kind', 'type || part AS kind')} SELECT node, kind AS value FROM w WHERE node LIKE 'c%'")
def c18_inherited_value(spark, sf_dir):
    """A text, of the field or of the nearest one above that has it."""
    df = nodes(spark, sf_dir).withColumn("v", F.concat("type", "part"))
    return trees.inherited(df, "v").where("node LIKE 'c%'")


_LIVE = "(SELECT DISTINCT 'c' || o_custkey AS node FROM orders WHERE o_orderstatus = 'F')"


def _live(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).distinct()


_LIVING = f"WITH t AS (SELECT * FROM {_NODES}), l AS (SELECT node FROM {_LIVE}), u AS (SELECT node FROM l UNION SELECT t.parent FROM t JOIN l USING (node) UNION SELECT p.parent FROM t JOIN l USING (node) JOIN t p ON p.node = t.parent)"


@book.query(f"{_LIVING} SELECT node FROM u WHERE node IS NOT NULL")
def c22_live_fields(spark, sf_dir):
    return trees.with_live_descendant(nodes(spark, sf_dir), _live(spark, sf_dir))


@book.query(f"{_LIVING} SELECT parent, list(node ORDER BY node) AS kids FROM t WHERE parent IS NOT NULL AND node IN (SELECT node FROM u) GROUP BY parent")
def c23_pruned_kids(spark, sf_dir):
    df = nodes(spark, sf_dir)
    kept = df.join(trees.with_live_descendant(df, _live(spark, sf_dir)), "node", "left_semi").where("parent IS NOT NULL")
    return kept.groupBy("parent").agg(F.array_sort(F.collect_list("node")).alias("kids"))


@book.query(f"{_LIVING} SELECT node, part FROM t WHERE parent IS NULL AND node IN (SELECT node FROM u)")
def c24_scrubbed_fields(spark, sf_dir):
    df = nodes(spark, sf_dir)
    return df.where("parent IS NULL").join(trees.with_live_descendant(df, _live(spark, sf_dir)), "node", "left_semi").select("node", "part")


@book.query(f"{_WALK} SELECT node FROM w WHERE split_part(name, '.', 1) = 'ASIA'")
def g28_reachable(spark, sf_dir):
    df = nodes(spark, sf_dir)
    edges = df.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    return trees.reachable(edges, df.where("part = 'ASIA' AND parent IS NULL").select("node"))


_FT = "CASE p_partkey % 5 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Ch' WHEN 2 THEN 'Btn' WHEN 3 THEN 'Sig' END"


def _parts(spark, sf_dir) -> DataFrame:
    """k, doc_id (a third of the parts each), name, ft, flags, value and default of a field for each part."""
    ft = F.element_at(F.array(*[F.lit(x) for x in ("Tx", "Ch", "Btn", "Sig", "Zz")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    flags = F.when(ft == "Tx", F.col("p_size") * 4096).when(ft == "Btn", F.col("p_size") * 32768)
    default = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 3).alias("doc_id"), F.col("p_type").alias("name"), ft.alias("ft"), flags.alias("flags"), F.col("p_name").alias("value"), default.alias("default"))


@book.query(f"SELECT p_partkey AS k, CASE {_FT} WHEN 'Tx' THEN CASE WHEN (p_size * 4096) & 4096 <> 0 THEN 'multiline_text' ELSE 'text' END WHEN 'Ch' THEN 'dropdown' WHEN 'Btn' THEN CASE WHEN (p_size * 32768) & 32768 <> 0 THEN 'radio' WHEN (p_size * 32768) & 65536 <> 0 THEN 'unknown' ELSE 'checkbox' END WHEN 'Sig' THEN 'signature' ELSE 'unknown' END AS field_type FROM part")
def b15_classify(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", O.field_kind(F.col("ft"), F.col("flags")).alias("field_type"))


@book.query("SELECT event_id AS k, CASE WHEN event_type = 'click' THEN 'reset_form' ELSE 'unsupported' END AS action FROM events")
def b16_button_action(spark, sf_dir):
    action = F.when(F.col("event_type") == "click", "ResetForm").when(F.col("event_type") != "view", "SubmitForm")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), O.button_action(action).alias("action"))


@book.query("SELECT c_custkey AS doc_id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = 2)")
def b13_fields_of_page(spark, sf_dir):
    """A field per customer with a widget per order."""
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    widgets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("page")).join(fields, "doc_id")
    return O.fields_of_page(fields, widgets, 2)


@book.query("SELECT c_custkey AS doc_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_form FROM customer")
def b14_has_form(spark, sf_dir):
    fields = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))
    return O.with_has_form(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), fields)


@book.query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS label FROM part")
def h16_option_label(spark, sf_dir):
    option = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).when(F.col("p_size") % 3 == 1, F.array("p_brand")).otherwise(F.array("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), O.option_label(option).alias("label"))


@book.query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [p_brand, p_type] END AS states FROM part")
def h17_on_states(spark, sf_dir):
    names = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Off"), "p_brand")).otherwise(F.array("p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), O.on_states(F.map_from_arrays(names, names)).alias("states"))


#: Named are two fields of document 1 and one of document 2: the others of those names aren't.
_LISTED = "(p_partkey % 3, p_type) IN ((1, 'ECONOMY'), (1, 'PROMO'), (2, 'PROMO'))"
_NAMED = [(1, "ECONOMY"), (1, "PROMO"), (2, "PROMO")]


@book.query(f"SELECT p_partkey AS k, s.scope FROM part, (SELECT 'all' AS scope UNION ALL SELECT 'only' UNION ALL SELECT 'except') s WHERE s.scope = 'all' OR (s.scope = 'only') = ({_LISTED})")
def g07_reset_scope(spark, sf_dir):
    """Fields in each kind of scope over names of two documents."""
    names = spark.createDataFrame(_NAMED, "doc_id long, name string")
    parts = [O.in_scope(_parts(spark, sf_dir), scope, names).select("k", F.lit(scope).alias("scope")) for scope in (O.ALL, O.ONLY, O.EXCEPT)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@book.query("SELECT o_orderkey AS button, CASE WHEN o_custkey % 4 = 0 THEN 'all' WHEN (o_custkey & 1) = 0 THEN 'only' ELSE 'except' END AS scope FROM orders")
def g08_scope_of_button(spark, sf_dir):
    names = F.when(F.col("o_custkey") % 4 != 0, F.array("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("button"), O.reset_scope(names, F.col("o_custkey")).alias("scope"))


@book.query(f"SELECT p_partkey AS k, CASE WHEN NOT ({_LISTED}) THEN p_name WHEN {_FT} = 'Sig' THEN NULL WHEN p_size % 2 = 0 THEN p_brand WHEN {_FT} = 'Btn' THEN 'Off' ELSE '' END AS value FROM part")
def g09_reset_in_scope(spark, sf_dir):
    """Only the named fields go back to their default."""
    names = spark.createDataFrame(_NAMED, "doc_id long, name string")
    return O.reset(_parts(spark, sf_dir), O.ONLY, names).select("k", "value")


@book.query(f"SELECT p_partkey AS k, CASE {_FT} WHEN 'Btn' THEN CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Off' END WHEN 'Sig' THEN NULL ELSE CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END END AS value FROM part")
def g10_reset_field(spark, sf_dir):
    return O.reset(_parts(spark, sf_dir), O.ALL).select("k", "value")


@book.query("SELECT l_orderkey AS field, l_linenumber AS kid, CASE WHEN l_linenumber % 3 = l_orderkey % 3 THEN 'v' || l_orderkey % 3 ELSE 'Off' END AS state FROM lineitem")
def g11_radio_states(spark, sf_dir):
    """The kids that bear the value are on, their siblings are off; every order is a form with one group."""
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").withColumn("name", F.lit("group"))
    kids = rows.select(F.col("l_orderkey").alias("doc_id"), "name", F.col("l_linenumber").alias("kid"), F.array(F.lit("Off"), name("l_linenumber")).alias("states"))
    values = rows.select(F.col("l_orderkey").alias("doc_id"), "name", name("l_orderkey").alias("value")).distinct()
    return O.button_states(kids, values).select(F.col("doc_id").alias("field"), "kid", "state")


@book.query("SELECT n_nationkey AS doc_id, c_custkey AS field, CASE WHEN n_nationkey = 1 AND s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS value FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey, nation WHERE n_nationkey < 3")
def g12_set_values(spark, sf_dir):
    """A keyed update in one of three copies of a form: new values where there are some."""
    copies = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("doc_id"))
    fields = copies.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("value")), F.lit(True))
    new = table(spark, sf_dir, "supplier").select(F.lit(1).cast("int").alias("doc_id"), F.col("s_suppkey").alias("name"), F.col("s_name").alias("value")).join(fields.select("name").distinct(), "name", "left_semi")
    return O.set_values(fields, new).select("doc_id", F.col("name").alias("field"), "value")


@book.query("""WITH f AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS t, o_orderstatus AS v FROM orders), w AS (SELECT l_orderkey AS doc_id, l_linenumber AS widget, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
    r AS (SELECT f.*, widget, CAST(widget % 4 AS INTEGER) AS page, CASE WHEN widget % 3 > 0 THEN 's' || widget END AS state, row_number() OVER (PARTITION BY doc_id ORDER BY widget) AS n FROM f JOIN w USING (doc_id) WHERE widget % 4 <> 0)
    SELECT doc_id, (['text', 'dropdown', 'radio', 'checkbox', 'unknown', 'signature'])[CAST(t + 1 AS INTEGER)] AS kind, CASE WHEN t < 2 THEN CASE WHEN v = 'F' THEN '' ELSE v END WHEN t < 4 THEN CASE WHEN v = 'F' THEN 'Off' ELSE v END ELSE '' END AS value,
        CASE t WHEN 2 THEN coalesce(state, '') WHEN 3 THEN coalesce(state, 'Yes') ELSE '' END AS export_value, CASE WHEN t = 1 THEN ['shown', 'both'] ELSE CAST([] AS VARCHAR[]) END AS options, t = 0 AS read_only, widget, page FROM r WHERE n = 1 OR t = 2""")
def c12_form_fields(spark, sf_dir):
    """A form per order: groups of radio buttons give a row per button, other fields one."""
    kind = F.col("o_orderkey") % 6
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (kind + 1).cast("int"))
    options = F.array(F.array(F.lit("export"), F.lit("shown")), F.array(F.lit("both")))
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("f").alias("name"), pick("Tx", "Ch", "Btn", "Btn", "Btn", "Sig").alias("ft"), pick(1, 0, O.RADIO, 0, O.PUSHBUTTON, 0).alias("flags"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value"), options.alias("options"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("widget")).agg(F.min("l_quantity"))
    states = F.when(F.col("widget") % 3 > 0, F.array(F.lit("Off"), F.concat(F.lit("s"), F.col("widget").cast("string")))).otherwise(F.array(F.lit("Off")))
    widgets = rows.select("doc_id", F.lit("f").alias("name"), "widget", (F.col("widget") % 4).cast("int").alias("page"), states.alias("states"))
    return O.form_fields(fields, widgets).drop("name")


@book.query("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN [p_brand, p_type] ELSE [p_name, p_brand, p_type] END AS options FROM part")
def g45_dropdown_options(spark, sf_dir):
    current = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), O.offered(F.array("p_brand", "p_type"), current).alias("options"))


_DAS = ("/Helv 12 Tf 0 g", "0.5 g /TiRo 9.5 Tf", "1 0 0 rg", "/Cour 8 Tf 0 0 0 1 k 0 1 0 rg", "Tf g", "/Zz x Tf 0.2 0.4 0.6 0.5 k")


@book.query("""SELECT p_partkey AS k, ([NULL, NULL, NULL, NULL, NULL, NULL])[1] IS NULL AND p_partkey % 6 IN (2, 4, 5) AS no_font, ([12.0::DOUBLE, 9.5::DOUBLE, NULL, 8.0::DOUBLE, NULL, NULL])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS size,
    (['#000000', '#808080', '#ff0000', '#00ff00', NULL, '#664d33'])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS color FROM part""")
def h11_appearance_style(spark, sf_dir):
    da = F.element_at(F.array(*[F.lit(d) for d in _DAS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.appearance_style(da).alias("s"))
    return df.select("k", F.col("s.font").isNull().alias("no_font"), "s.size", "s.color")


@book.query("SELECT p_partkey AS k, '0.5 w 0 G' || chr(10) || '0.50 0.50 ' || printf('%.2f', greatest(p_size * 10.0::DOUBLE - 1.0, 0.0)) || ' 19.00 re S' || chr(10) || '1.5 w 1 J 1 j' || chr(10) || printf('%.2f', 0.25 * (p_size * 10.0::DOUBLE)) || ' 10.00 m' || chr(10) || printf('%.2f', 0.75 * (p_size * 10.0::DOUBLE)) || ' 5.00 l' || chr(10) || 'S' || chr(10) || printf('%.2f', 0.5 * (p_size * 10.0::DOUBLE)) || ' 15.00 m' || chr(10) || printf('%.2f', 0.5 * (p_size * 10.0::DOUBLE)) || ' 15.00 l' || chr(10) || 'S' || chr(10) AS drawing FROM part")
def h29_signature_appearance(spark, sf_dir):
    """Two strokes in a box as wide as the part is large: a line and a dot."""
    point = lambda x, y: F.array(F.lit(x), F.lit(y))
    strokes = F.array(F.array(point(0.25, 0.5), point(0.75, 0.75)), F.array(point(0.5, 0.25)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), O.signature_drawing(strokes, F.col("p_size") * 10.0, F.lit(20.0)).alias("drawing"))


_SIGNED = "(SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'old ' || p_name END AS old, 'S' || (p_partkey % 3) AS name, CAST(p_partkey // 3 AS BIGINT) AS doc_id, CAST(p_size AS BIGINT) AS s FROM part)"


def _signatures(spark, sf_dir):
    """Signature fields of parts, three a document; of every second there is a drawing. New strokes
    come for the first of each document, none any more for the second."""
    k = F.col("p_partkey")
    here = table(spark, sf_dir, "part").select(
        (F.floor(k / 3)).cast("long").alias("doc_id"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("name"),
        F.array(F.lit(110.0), F.lit(60.0), F.lit(10.0), 60.0 + F.col("p_size")).alias("rect"), F.when(k % 2 == 0, F.concat(F.lit("old "), "p_name")).alias("appearance"),
    )
    stroke = F.array(F.array(F.array(F.lit(0.5), F.lit(1.0))))
    return here, here.where("name <> 'S2'").select("doc_id", "name", F.when(F.col("name") == "S0", stroke).alias("strokes"))


@book.query(f"""SELECT doc_id, name, CASE name WHEN 'S2' THEN old WHEN 'S0' THEN '0.5 w 0 G' || chr(10) || '0.50 0.50 99.00 ' || (s - 1) || '.00 re S' || chr(10) || '1.5 w 1 J 1 j' || chr(10)
    || '50.00 0.00 m' || chr(10) || '50.00 0.00 l' || chr(10) || 'S' || chr(10) END AS appearance FROM {_SIGNED}""")
def g13_signature_strokes(spark, sf_dir):
    fields, new = _signatures(spark, sf_dir)
    return O.set_strokes(fields, new).select("doc_id", "name", "appearance")


@book.query(f"SELECT doc_id, name, old AS appearance FROM {_SIGNED} WHERE old IS NOT NULL AND name <> 'S2'")
def g13_orphaned_drawings(spark, sf_dir):
    fields, new = _signatures(spark, sf_dir)
    return O.orphaned(fields, O.set_strokes(fields, new))
