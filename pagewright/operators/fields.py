"""Form fields as rows: what they are, what resetting and setting them gives, where they are.

Field tables have doc_id, name (full dotted name), ft (inherited type), flags and value;
widgets doc_id, widget, own_page; annotations doc_id, page, widget. Fields are met by doc_id and
name, so copies of a form don't meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of field flags.
READ_ONLY, MULTILINE, RADIO, PUSHBUTTON, COMB = 1, 1 << 12, 1 << 15, 1 << 16, 1 << 24
ALL, ONLY, EXCEPT = "all", "only", "except"


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def field_kind(ft: Column, flags: Column) -> Column:
    """Text, multiline_text, dropdown, radio, checkbox, signature or unknown."""
    text = F.when(has_flag(flags, MULTILINE), "multiline_text").otherwise("text")
    button = F.when(has_flag(flags, RADIO), "radio").when(has_flag(flags, PUSHBUTTON), "unknown").otherwise("checkbox")
    return F.when(ft == "Tx", text).when(ft == "Ch", "dropdown").when(ft == "Btn", button).when(ft == "Sig", "signature").otherwise("unknown")


def button_action(action: Column) -> Column:
    """Resetting is the only action of a button that is carried out."""
    return F.when(action == "ResetForm", "reset_form").otherwise("unsupported")


def fields_of_page(fields: DataFrame, widgets: DataFrame, page: int) -> DataFrame:
    """Fields with a widget on a page."""
    return fields.join(widgets.where(F.col("page") == page).select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi")


def with_has_form(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """``docs`` with has_form: whether there is any field."""
    some = fields.select("doc_id").distinct().withColumn("has_form", F.lit(True))
    return docs.join(some, "doc_id", "left").withColumn("has_form", F.coalesce("has_form", F.lit(False)))


def option_label(option: Column) -> Column:
    """An option is a text, or a pair of what is exported and what is shown."""
    return F.coalesce(F.try_element_at(option, F.lit(2)), F.try_element_at(option, F.lit(1)))


def on_states(appearances: Column) -> Column:
    """Names of a button's appearances that aren't the one for off."""
    return F.array_remove(F.map_keys(appearances), "Off")


def offered(options: Column, current: Column) -> Column:
    """The options, with the current value in front where it is none of them."""
    return F.when(F.array_contains(options, current), options).otherwise(F.array_prepend(options, current))


def reset_scope(names: Column, flags: Column) -> Column:
    """Without names everything; else the lowest flag bit says all but these, or only these."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, ALL).when(has_flag(flags, 1), EXCEPT).otherwise(ONLY)


_KEYS = ["doc_id", "name"]


def in_scope(fields: DataFrame, scope: str, names: DataFrame | None = None) -> DataFrame:
    """Fields that a scope takes in: all, only those named, or all except those. ``names`` has
    doc_id and name; of documents that it doesn't have, no field is named."""
    if scope == ALL:
        return fields
    return fields.join(names.select(*_KEYS).distinct(), _KEYS, "left_semi" if scope == ONLY else "left_anti")


def cleared(ft: Column, default: Column) -> Column:
    """A field's value after a reset: the default, else off for a button, nothing for a
    signature and an empty text for others."""
    return F.when(ft == "Sig", F.lit(None).cast("string")).otherwise(F.coalesce(default, F.when(ft == "Btn", "Off").otherwise("")))


def reset(fields: DataFrame, scope: str, names: DataFrame | None = None) -> DataFrame:
    """Fields (doc_id, name, ft, value, default, ...) with those in scope reset, the others as
    they are."""
    if scope == ALL:
        return fields.withColumn("value", cleared(F.col("ft"), F.col("default")))
    listed = names.select(*_KEYS).distinct().withColumn("_listed", F.lit(True))
    rows = fields.join(listed, _KEYS, "left")
    taken = F.coalesce("_listed", F.lit(False)) == (scope == ONLY)
    return rows.withColumn("value", F.when(taken, cleared(F.col("ft"), F.col("default"))).otherwise(F.col("value"))).drop("_listed")


def button_states(kids: DataFrame, values: DataFrame) -> DataFrame:
    """Kids (doc_id, name, kid, states) with the state each shows for the field's new value
    (doc_id, name, value): the value where the kid has an appearance of that name, else off."""
    rows = kids.join(values, _KEYS)
    return rows.withColumn("state", F.when(F.array_contains("states", F.col("value")), F.col("value")).otherwise("Off"))


def set_values(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Fields with the values of ``new`` (doc_id, name, value) where there are some. A name
    that no field of its document has fails the job."""
    given = new.select(*_KEYS, F.col("value").alias("_new"), F.lit(True).alias("_given"))
    here = fields.withColumn("_here", F.lit(True))
    rows = here.join(given, _KEYS, "full_outer").where(F.assert_true(F.coalesce("_here", F.lit(False)), "no field of that name").isNull())
    return rows.withColumn("value", F.when(F.col("_given"), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_given", "_here")


def form_fields(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """What a form offers: doc_id, name, kind, value, export_value, options,
    read_only, widget and page of terminal fields (doc_id, name, ft, flags, value, options) by their
    widgets (doc_id, name, widget, page, states; states are names of appearances).

    A group of radio buttons is a row per button, each with its own export value, '' where it has
    no state for on, and the group's value; any other field is one row, at its least widget. A box
    that names no state exports Yes. Texts and lists have their value, or an empty one; buttons
    have Off for none; lists have the shown texts of their options. Fields without a widget on a
    page are left out.
    """
    kind = field_kind(F.col("ft"), F.col("flags"))
    on = F.try_element_at(F.array_remove("states", "Off"), F.lit(1))
    here = widgets.where("page <> 0").select(*_KEYS, "widget", "page", on.alias("_on"))
    rows = fields.withColumn("kind", kind).join(here, _KEYS)
    place = Window.partitionBy(*_KEYS).orderBy("widget")
    rows = rows.withColumn("_n", F.row_number().over(place)).where((F.col("_n") == 1) | (F.col("kind") == "radio"))
    value = F.when(F.col("kind").isin("text", "multiline_text", "dropdown"), F.coalesce("value", F.lit(""))).when(F.col("kind").isin("radio", "checkbox"), F.coalesce("value", F.lit("Off"))).otherwise("")
    export = F.when(F.col("kind") == "radio", F.coalesce("_on", F.lit(""))).when(F.col("kind") == "checkbox", F.coalesce("_on", F.lit("Yes"))).otherwise("")
    shown = F.when(F.col("kind") == "dropdown", F.transform("options", option_label))
    options = F.coalesce(shown, F.array().cast("array<string>"))
    return rows.select(*_KEYS, "kind", value.alias("value"), export.alias("export_value"), options.alias("options"), has_flag(F.col("flags"), READ_ONLY).alias("read_only"), "widget", "page")


def widget_pages(annotations: DataFrame) -> DataFrame:
    """doc_id, widget and the (first) page it is on, of every annotation on a page."""
    return annotations.groupBy("doc_id", "widget").agg(F.min("page").alias("page"))


def placed(widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """Widgets with their page: the one they are listed on, else their own note of it; those
    with neither, or with page 0, are left out."""
    rows = widgets.join(pages.withColumnRenamed("page", "_listed"), ["doc_id", "widget"], "left")
    return rows.withColumn("page", F.coalesce("_listed", "own_page")).where("page <> 0").drop("_listed", "own_page")


def referred(*places: DataFrame) -> DataFrame:
    """Objects that several places refer to (ref), each once."""
    out = places[0].select("ref")
    for more in places[1:]:
        out = out.unionByName(more.select("ref"))
    return out.where("ref IS NOT NULL").dropDuplicates(["ref"])


def byte_range(numbers: Column) -> Column:
    """The numbers, if they are four and none is negative; else null."""
    return F.when((F.size(numbers) == 4) & F.forall(numbers, lambda x: F.coalesce(x >= 0, F.lit(False))), numbers)


def coverage_end(spans: Column) -> Column:
    """Where the bytes end that a range of two spans covers."""
    return F.element_at(spans, 3) + F.element_at(spans, 4)


def appended(spans: Column, size: Column) -> Column:
    """Bytes were added behind what is covered."""
    return coverage_end(spans) < size


def signature_drawing(strokes: Column, width: Column, height: Column) -> Column:
    """Drawing operators of strokes (arrays of points, of 0 to 1 from the upper left) in a
    box with a border; a stroke of one point is a dot."""
    at = lambda p: F.format_string("%.2f %.2f", p[0] * width, (F.lit(1.0) - p[1]) * height)

    def stroke(s: Column) -> Column:
        first = F.concat(at(s[0]), F.lit(" m\n"), F.when(F.size(s) == 1, F.concat(at(s[0]), F.lit(" l\n"))).otherwise(""))
        rest = F.array_join(F.transform(F.slice(s, F.lit(2), F.size(s)), lambda p: F.concat(at(p), F.lit(" l\n"))), "")
        return F.concat(first, rest, F.lit("S\n"))

    border = F.format_string("0.5 w 0 G\n0.50 0.50 %.2f %.2f re S\n1.5 w 1 J 1 j\n", F.greatest(width - 1.0, F.lit(0.0)), F.greatest(height - 1.0, F.lit(0.0)))
    return F.concat(border, F.array_join(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), stroke), ""))


def set_strokes(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Signature fields (doc_id, name, rect: four numbers, appearance) whose appearance is
    drawn anew from the strokes of ``new`` (doc_id, name, strokes), or taken away where they are
    empty or null; the others are as they are.

    A name that no field of its document has and a field to change without a rectangle fail the
    job. What was replaced isn't held by any field: see `orphaned`.
    """
    given = new.select(*_KEYS, F.col("strokes").alias("_strokes"), F.lit(True).alias("_given"))
    rows = fields.withColumn("_here", F.lit(True)).join(given, _KEYS, "full_outer").withColumn("_given", F.coalesce("_given", F.lit(False)))
    known = F.coalesce("_here", F.lit(False))
    placed = ~F.col("_given") | (F.coalesce(F.size("rect"), F.lit(0)) == 4)
    rows = rows.where(F.assert_true(known, "no signature field of that name").isNull() & F.assert_true(placed, "a signature field without a rectangle").isNull())
    side = lambda k: F.abs(F.col("rect")[k + 2] - F.col("rect")[k])
    drawn = F.when(F.size("_strokes") > 0, signature_drawing(F.col("_strokes"), side(0), side(1)))
    return rows.withColumn("appearance", F.when(F.col("_given"), drawn).otherwise(F.col("appearance"))).drop("_here", "_given", "_strokes")


def orphaned(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, name and appearance of drawings that a change of ``before`` into ``after`` left
    behind: what a writer of the file needn't keep."""
    held = before.where("appearance IS NOT NULL").select(*_KEYS, "appearance")
    now = after.select(*_KEYS, F.col("appearance").alias("_now"))
    return held.join(now, _KEYS, "left").where(~F.col("appearance").eqNullSafe(F.col("_now"))).drop("_now")
