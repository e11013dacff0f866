"""Label sheets: cells a person filled in, checked as a whole before any record is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import normalize as N
from verdigris.functions import spans as Sp
from verdigris.functions import text as T
from verdigris.plans.registry import Registry, Task

SEPARATOR = ";"


def unquoted(c: Column) -> Column:
    """Without one pair of curly or straight quotes around the whole."""
    t = F.trim(c)
    curly = F.regexp_extract(t, r"(?s)^(?:“(.+)”|‘(.+)’)$", 1)
    single = F.regexp_extract(t, r"(?s)^(?:“(.+)”|‘(.+)’)$", 2)
    return F.coalesce(F.nullif(F.trim(curly), F.lit("")), F.nullif(F.trim(single), F.lit("")), T.strip_quotes(t))


def looks_like_a_name(part: Column) -> Column:
    """Whether a piece could be an entry by itself: a legal suffix, or two capitalized words."""
    words = F.split(F.trim(part), r"\s+")
    suffix = F.arrays_overlap(F.split(F.replace(F.lower(part), F.lit("."), F.lit("")), r"\s+"), F.array(*(F.lit(s) for s in T.LEGAL_SUFFIXES)))
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(words) > 1) & (suffix | (capitals >= 2))


def joined_entries(items: Column) -> Column:
    """Items that look like several entries in one."""
    return F.filter(items, lambda x: F.size(F.filter(F.split(x, r"(?i)\s+and\s+|\s+&\s+|\s*/\s*|,\s+"), looks_like_a_name)) > 1)


def skip_reason(notes: Column) -> Column:
    """What stands behind ``skip`` in the notes; null if the row is not skipped, empty if no reason is given."""
    pattern = r"(?is)^\s*skip\b\s*[:\-–—]?\s*(.*)$"
    return F.when(notes.rlike(pattern), F.trim(F.regexp_extract(notes, pattern, 1)))


def cell_text(c: Column, kind: str = "string") -> Column:
    """A typed cell as text: yes and no, ISO dates, whole numbers without a point."""
    if kind == "boolean":
        return F.when(c, "yes").when(~c, "no").otherwise("")
    if kind in ("date", "timestamp"):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    if kind == "double":
        return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def render_cell(kind: str, value: Column) -> Column:
    """A stored value of a task type as the text that a person writes; nothing is an empty cell.

    Numbers are STRUCT<value, unit>, spans the quoted passage, lists and sets arrays.
    """
    if kind == "binary":
        text = F.when(F.lower(value.cast("string")) == "true", "yes").when(F.lower(value.cast("string")) == "false", "no")
    elif kind in ("multilabel", "extract_list"):
        text = F.array_join(value, f"{SEPARATOR} ")
    elif kind == "extract_numeric":
        number = F.when(value["value"] == F.floor(value["value"]), F.floor(value["value"]).cast("string")).otherwise(value["value"].cast("string"))
        text = F.concat_ws(" ", number, value["unit"])
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def parse_cell(task: Task, cell: Column, doc: Column) -> Column:
    """STRUCT<value STRING, error STRING, warnings ARRAY<STRING>>: a cell as a stored label; lists and structs as JSON."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    members = ", ".join(task.enum)
    nothing, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    blank_error = nothing if task.nullable else F.lit("this task may not be blank")

    def result(value: Column, error: Column, warnings: Column = none) -> Column:
        return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"), warnings.alias("warnings"))

    known = F.array(*(F.lit(m) for m in task.enum)) if task.enum else none
    if task.type in ("multilabel", "extract_list"):
        blank = (t == "") | T.is_null_word(t, task.params.get("null_tokens"))
        pieces = F.filter(F.transform(F.split(F.replace(t, F.lit("\n"), F.lit(SEPARATOR)), SEPARATOR), unquoted), lambda x: x != "")
        items = F.when(blank, none).otherwise(pieces)
        if task.type == "extract_list":
            return T.let(items, lambda i: result(F.to_json(i), nothing, F.transform(joined_entries(i), lambda x: F.concat(x, F.lit(" may be more than one entry")))))

        def members_of(pairs: Column) -> Column:
            wrong = F.filter(pairs, lambda s: ~F.coalesce(F.array_contains(known, s["m"]), F.lit(False)))
            right = F.array_sort(F.array_distinct(F.transform(pairs, lambda s: s["m"])))
            return result(F.to_json(right), F.when(F.size(wrong) > 0, F.concat(F.get(wrong, F.lit(0))["x"], F.lit(f" is not one of: {members}"))))

        return T.let(F.transform(items, lambda x: F.struct(x.alias("x"), N.enum(x, task.params).alias("m"))), members_of)
    if task.type == "multiclass":
        return T.let(F.when(t != "", N.enum(t, task.params)), lambda m: result(m, F.when(m.isNull(), blank_error).when(~F.array_contains(known, m), F.concat(t, F.lit(f" is not one of: {members}")))))
    blank = (t == "") | T.is_null_word(t, task.params.get("null_tokens"))
    error = lambda bad, what: F.when(blank, blank_error).when(bad, what)
    given = lambda c: F.when(~blank, c)
    if task.type == "binary":
        return T.let(N.boolean(t, task.params), lambda b: result(given(b), error(~b.isin("true", "false"), F.concat(t, F.lit(" is not yes or no")))))
    if task.type in ("extract_exact", "extract_fuzzy"):
        return result(given(unquoted(t)), error(F.lit(False), nothing))
    if task.type == "extract_numeric":
        unit = task.params.get("unit")

        def number(q: Column) -> Column:
            other = F.when(~blank & q["unit"].isNotNull() & (q["unit"] != F.lit(unit)), F.array(F.concat(F.lit("unit "), q["unit"], F.lit(f" differs from the declared {unit}")))).otherwise(none) if unit else none
            return result(given(F.to_json(F.struct(q["value"].alias("value"), q["unit"].alias("unit")))), error(q["value"].isNull(), F.concat(t, F.lit(" is not a number"))), other)

        return T.let(N.numeric(t, task.params), number)
    if task.type == "extract_date":
        return T.let(N.date(t, task.params), lambda d: result(given(d["iso"]), error(d["iso"].isNull(), F.concat(t, F.lit(" is not a date")))))

    def place(at: Column) -> Column:
        again = Sp.locate(F.substr(doc, at["stop"] + 1, F.length(doc)), t, folded=False).isNotNull()
        return result(given(F.to_json(at)), error(at.isNull(), F.lit("the passage is not in the text")), F.when(~blank & again, F.array(F.lit("the passage appears more than once; the first is used"))).otherwise(none))

    return T.let(Sp.locate(doc, t), place)


def import_sheet(rows: DataFrame, plan: DataFrame, texts: DataFrame, registry: Registry, inclusion_probability: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, problems, warnings) of a sheet (doc_id, notes, a column per task) for a plan (doc_id, is_prefilled).

    Every problem is listed at once.  Records are good only if there is none: the sheet counts as a whole.
    """
    tasks = list(registry)
    sheet = rows.select("doc_id", F.coalesce("notes", F.lit("")).alias("notes"), *(F.trim(F.coalesce(F.col(t.id), F.lit(""))).alias(t.id) for t in tasks))
    copies = sheet.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_copies"))
    one = sheet.dropDuplicates(["doc_id"]).join(copies, "doc_id").join(plan.select("doc_id", "is_prefilled", F.lit(True).alias("_planned")), "doc_id", "left").join(texts.select("doc_id", F.col("text").alias("_text"), F.lit(True).alias("_there")), "doc_id", "left")
    reason = skip_reason(F.col("notes"))
    empty = (F.trim("notes") == "") & (F.concat(*(F.col(t.id) for t in tasks)) == "")
    one = one.withColumn("_state", F.when(F.col("_planned").isNull(), "not in the sample").when(reason == "", "skipped with no reason").when(reason.isNotNull(), "skipped").when(empty, "nothing filled in yet").when(F.col("_there").isNull(), "no text").otherwise("ok"))
    cells = one.where("_state = 'ok'").select("doc_id", "notes", "is_prefilled", F.struct(*(parse_cell(t, F.col(t.id), F.col("_text")).alias(t.id) for t in tasks)).alias("c"))
    each = cells.select("doc_id", F.explode(F.array(*(F.struct(F.lit(t.id).alias("task_id"), F.col(f"c.{t.id}.error").alias("error"), F.col(f"c.{t.id}.warnings").alias("warnings")) for t in tasks))).alias("e")).select("doc_id", "e.*")
    missing = plan.select("doc_id").join(sheet, "doc_id", "left_anti")
    blank = F.lit(None).cast("string")
    problems = (
        one.where("_copies > 1").select("doc_id", blank.alias("task_id"), F.lit("appears in more than one row").alias("problem"))
        .unionByName(one.where(~F.col("_state").isin("ok", "skipped")).select("doc_id", blank.alias("task_id"), F.col("_state").alias("problem")))
        .unionByName(each.where("error is not null").select("doc_id", "task_id", F.col("error").alias("problem")))
        .unionByName(missing.select("doc_id", blank.alias("task_id"), F.lit("has no row").alias("problem")))
    )
    bad = problems.select("doc_id").distinct()
    labels = F.struct(*(F.col(f"c.{t.id}.value").alias(t.id) for t in tasks))
    records = cells.join(bad, "doc_id", "left_anti").select("doc_id", labels.alias("labels"), F.lit("random").alias("stratum"), F.lit(inclusion_probability).alias("inclusion_probability"), F.when(F.col("is_prefilled"), "corrected").otherwise("blind").alias("labeling_mode"), "notes")
    return records, problems, each.select("doc_id", "task_id", F.explode("warnings").alias("warning"))


def schema_problems(labels: DataFrame, registry: Registry) -> DataFrame:
    """(doc_id, task_id, problem) of stored labels (doc_id, labels MAP<STRING, STRING>): unknown and missing tasks, values outside an enum."""
    ids = F.array(*(F.lit(t.id) for t in registry))
    keys = F.map_keys("labels")
    row = lambda tasks, what: labels.select("doc_id", F.explode(tasks).alias("task_id")).withColumn("problem", F.lit(what))
    out = row(F.array_except(keys, ids), "unknown task").unionByName(row(F.array_except(ids, keys), "missing task"))
    enums = [t for t in registry if t.enum and t.type == "multiclass"]
    for t in enums:
        v = F.try_element_at("labels", F.lit(t.id))
        out = out.unionByName(labels.where(v.isNotNull() & ~v.isin(*t.enum)).select("doc_id", F.lit(t.id).alias("task_id"), F.concat(F.lit("not in the enum: "), v).alias("problem")))
    return out


def sheet_frame(plan: DataFrame, values: DataFrame | None, registry: Registry, texts: DataFrame | None = None) -> DataFrame:
    """(file_name, notes, a text column per task) to fill in, by document: blind rows are empty, the others hold ``values``.

    ``plan`` has doc_id and is_prefilled, ``values`` doc_id and a struct ``values`` with a field per task.
    """
    rows = plan if values is None else plan.join(values.select("doc_id", "values"), "doc_id", "left")
    cells = []
    for t in registry:
        given = F.lit("") if values is None else render_cell(t.type, F.col(f"values.{t.id}"))
        cells.append(F.when(F.col("is_prefilled"), given).otherwise("").alias(t.id))
    return rows.select(F.col("doc_id").alias("file_name"), F.lit("").alias("notes"), *cells).orderBy("file_name")


def write_sheet(sheet: DataFrame, path: str) -> None:
    """The sheet as one CSV file with a header, for a person to open: a sample, so one task writes it."""
    sheet.coalesce(1).sortWithinPartitions("file_name").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_workbook(sheet: DataFrame, registry: Registry, path: str) -> None:
    """The sheet as an XLSX workbook: rows to be labelled blind are shaded, enums have drop-down lists."""
    from verdigris.sources.xlsx import write_xlsx

    rows = [["" if v is None else str(v) for v in r] for r in sheet.orderBy("file_name").collect()]
    blind = {i for i, r in enumerate(rows) if not any(r[2:])}
    choices = {t.id: ["yes", "no"] if t.type == "binary" else list(t.enum) for t in registry if t.type in ("binary", "multiclass")}
    write_xlsx(path, sheet.columns, rows, blind, choices)
