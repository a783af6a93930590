"""Reports whose columns must be read from their own header.

Everything is a column expression. A report's marker lines (rules, titles, page furniture) are found by filters on the
stored lines; of each report only the few lines around its rule are brought together, and its column limits and names
are one small array. The data lines meet that array once and are cut by it. Rows come as (path, line_no, cells), where
``cells`` maps column name to text, because columns differ from file to file.

Title lines that a later page repeats are not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pieces import (
    NAMED, cell_starts, dash_runs, gap_ends, ink_runs, opened, or_else, pieces, pipes, spans, starts, tidy, titled, under, unrepeated,
)
from ..functions.text import BLANKS, has_any, made_of, strip
from ..operators import lineage, occupancy, ordered
from .lines import grid_as_blanks, without_boilerplate


def raw_line() -> Column:
    return F.col("line")


# ---------------------------------------------------------------- cutting

def cut_cells(rows: DataFrame, columns: DataFrame, clean=None) -> DataFrame:
    """Cuts each line by its file's columns; ``_titles``, where there, are lines that are not rows, and ``_from`` is the line above the rows."""

    def value(c: Column) -> Column:
        raw = under(raw_line(), c)
        return clean(raw) if clean else raw

    own = columns.withColumns({"_names": F.transform("_columns", lambda c: c["name"])} | ({"_titles": F.transform("_titles", strip)} if "_titles" in columns.columns else {}))
    met = rows.join(own, "path")
    if "_from" in columns.columns:
        met = met.filter("line_no > _from")
    if "_titles" in columns.columns:
        met = met.filter(~F.array_contains("_titles", strip(raw_line())))
    cells = F.map_from_arrays("_names", F.transform("_columns", value))
    return met.select("path", "line_no", cells.alias("cells"))


def pick(rows: DataFrame, names: list[str]) -> DataFrame:
    """Chosen columns as a flat table; absent ones are empty text."""
    return rows.select(
        "path", "line_no", *[F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit("")).alias(n) for n in names])


def long_form(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("line_no").alias("row_no"), F.explode("cells").alias("column_name", "value"))


def _near(lines: DataFrame, places: DataFrame, above: int, below: int) -> DataFrame:
    """``places`` with ``_near``: the lines from ``above`` lines over ``_at`` to ``below`` under it, as (n, line), n counted from it."""
    n = (F.col("line_no") - F.col("_at")).cast("int")
    around = lines.select("path", "line_no", "line").join(places, "path").filter(n.between(-above, below))
    found = around.groupBy("path", "_at").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.rtrim("line").alias("line")))).alias("_near"))
    return places.join(found, ["path", "_at"])


def _down_to(lines: DataFrame, places: DataFrame, last: str, more: int = 0) -> DataFrame:
    """The lines down to the lowest of the stored places; parts of the stored lines that lie further down are not read."""
    lowest = places.agg(F.max(last)).first()[0]
    return lines.filter(F.col("line_no") <= (-1 if lowest is None else lowest + more))


def _texts(near: Column) -> Column:
    return F.transform(near, lambda x: x["line"])


# ---------------------------------------------------------------- columns under a rule of dash groups, or under titles beside a solid rule

# Words that mark page furniture, a framed title box, and lines below the header that are no rows.
_FURNITURE = ("REPORT ID:", "PROC DATE", "RUN DATE", "BRANCH CODE", "BRANCH NAME", "PAGE NO", "AREA:")
_BOX_WORDS = _FURNITURE + ("BRANCH NO",)
_DATA_SKIP = ("REPORT ID:", "RUN DATE:", "PROC DATE", "PAGE NO", "AREA:", "** END", "GRAND TOTAL", "BRANCH TOTAL")
_LOOK = 4


def _all_dashes(line: Column) -> Column:
    """Over ten dashes, blanks aside."""
    packed = F.replace(line, F.lit(" "), F.lit(""))
    return (F.length(packed) > 10) & made_of(packed, "-")


def _defining_rules(lines: DataFrame) -> DataFrame:
    """``(path, _at)``: of each file the first rule of three or more dash groups, else the first solid rule that
    is not the top of a box around page furniture."""
    text = strip(raw_line())
    kind = (
        F.when(_all_dashes(raw_line()) & raw_line().rlike("-+ +-+ +-+"), "groups")
        .when((F.length(F.rtrim(raw_line())) > 20) & made_of(text, "-="), "solid")
        .when((text == "") | made_of(text, "-="), "stop")
        .when(has_any(F.upper(raw_line()), _BOX_WORDS), "box")
    )
    marks = lineage.stored(lines.select("path", "line_no", kind.alias("kind")).filter("kind is not null"))
    # What each solid rule meets first in the lines under it decides whether it tops a box.
    solid = marks.filter("kind = 'solid'").select("path", F.col("line_no").alias("_at"))
    meets = solid.withColumn("line_no", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + _LOOK))).join(marks.filter("kind <> 'groups'"), ["path", "line_no"])
    boxed = meets.groupBy("path", "_at").agg(F.min_by("kind", "line_no").alias("first")).filter("first = 'box'")
    first = lambda rows, name: rows.groupBy("path").agg(F.min("_at").alias(name))
    plain = first(solid.join(boxed, ["path", "_at"], "left_anti"), "_solid")
    grouped = first(marks.filter("kind = 'groups'").withColumnRenamed("line_no", "_at"), "_grouped")
    return grouped.join(plain, "path", "full_outer").select("path", F.coalesce("_grouped", "_solid").alias("_at"))


def dash_columns(lines: DataFrame) -> DataFrame:
    rules = lineage.stored(_defining_rules(lines))
    text = strip(raw_line())
    furniture = lambda line: has_any(F.upper(line), _FURNITURE)
    unruled = lambda line: (strip(line) != "") & ~made_of(strip(line), "-= ")
    top = _down_to(lines, rules, "_at", _LOOK)
    over = top.join(rules, "path").filter("line_no < _at").filter(unruled(raw_line()) & ~furniture(raw_line()))
    above = over.groupBy("path").agg(F.max_by(F.rtrim(raw_line()), "line_no").alias("_above"))
    heads = _near(top, rules, _LOOK, _LOOK).join(above, "path", "left")

    near = F.col("_near")
    rule = F.get(F.filter(near, lambda x: x["n"] == 0), F.lit(0))["line"]
    heads = heads.withColumns({
        "_closing": F.array_min(F.transform(F.filter(near, lambda x: (x["n"] > 0) & _all_dashes(x["line"])), lambda x: x["n"])),
        "_ends": F.coalesce(F.array_max(F.transform(F.filter(near, lambda x: (x["n"] < 0) & ~(unruled(x["line"]) & ~furniture(x["line"]))), lambda x: x["n"])), F.lit(-_LOOK - 1)),
        "_groups": dash_runs(rule),
    })
    # Under a solid rule the titles give the limits: those between it and the closing one, else the nearest above.
    beside = F.when(
        F.col("_closing").isNotNull(), _texts(F.filter(near, lambda x: (x["n"] > 0) & (x["n"] < F.col("_closing")))),
    ).otherwise(F.when(F.col("_above").isNotNull(), F.array("_above")).otherwise(F.array().cast("array<string>")))
    heads = heads.withColumn("_beside", F.when(F.size("_groups") == 1, beside).otherwise(F.array().cast("array<string>")))
    first = F.get("_beside", F.lit(0))
    free = F.filter(gap_ends(first), lambda m: F.forall("_beside", lambda t: (m >= F.length(t)) | (F.substring(t, m + 1, 1) == " ")))
    groups = F.transform("_groups", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    heads = heads.withColumns({
        "_spans": F.when(first.contains("|"), spans(cell_starts(first))).when(F.size(gap_ends(first)) > 0, spans(F.concat(F.array(F.lit(0)), free))).otherwise(opened(groups)),
        "_titles": F.when(F.size("_beside") > 0, F.col("_beside")).otherwise(_texts(F.filter(near, lambda x: (x["n"] < 0) & (x["n"] > F.col("_ends"))))),
    })
    columns = lineage.stored(heads.select(
        "path", (F.col("_at") + F.coalesce("_closing", F.lit(0))).alias("_from"), unrepeated(titled(F.col("_spans"), F.col("_titles"))).alias("_columns"), "_titles"))

    upper = F.upper(text)
    data = lines.filter(
        (text != "") & ~made_of(text, " -=|") & ~text.rlike(r"[\x00-\x08\x0a-\x1f]")
        & ~has_any(upper, _DATA_SKIP) & ~upper.startswith("TOTAL") & ~upper.contains("TOT VOUCH"))
    rows = cut_cells(data, columns)
    # In one step, so that cells are cut once and not again for the filter.
    inked = F.filter(F.array(F.struct("cells")), lambda x: F.exists(F.map_values(x["cells"]), lambda v: v != ""))
    return rows.select("path", "line_no", F.inline(inked))


# ---------------------------------------------------------------- columns from the positions that are blank on every line

def _named_or_spilled(columns: Column, header: Column) -> Column:
    """Columns named by the header; one without a name belongs to the column on its left, or to none if it is the first."""

    def add(done: Column, column: Column) -> Column:
        name, n = under(header, column), F.size(done)
        named = F.struct(or_else(tidy(name), "COL").alias("name"), column["start"].alias("start"), column["end"].alias("end"))
        left = F.get(done, n - 1)
        wider = F.struct(left["name"].alias("name"), left["start"].alias("start"), column["end"].alias("end"))
        return F.when(name != "", F.array_append(done, named)).when(n > 0, F.array_append(F.slice(done, 1, n - 1), wider)).otherwise(done)

    return F.aggregate(columns, F.array().cast(NAMED), add)


def blank_columns(lines: DataFrame) -> DataFrame:
    """The line under the first rule is the header, the lines under the second one data; columns part midway between inked runs."""
    rows = without_boilerplate(grid_as_blanks(lines)).select("path", "line_no", "line")
    text = strip(raw_line())
    ruled = made_of(text, "-")
    nth = F.dense_rank().over(Window.partitionBy("path").orderBy("line_no"))
    two = rows.filter(ruled & F.col("line_no").isNotNull()).withColumn("_nth", nth).filter("_nth <= 2")
    at = lambda value, n: F.min_by(value, F.when(F.col("_nth") == n, F.col("line_no")))
    second = two.groupBy("path").agg(at("line_no", 1).alias("_first"), at("line_no", 2).alias("_second"), at("line", 2).alias("_rule")).filter("_second is not null")
    second = lineage.stored(second)
    top = _down_to(rows, second, "_second").filter(~ruled).join(second, "path")
    above = top.filter("line_no > _first and line_no < _second").groupBy("path").agg(F.min_by("line", "line_no").alias("_over"))
    header = second.join(above, "path", "left").select("path", F.coalesce("_over", "_rule").alias("_header"), "_second")
    header = lineage.stored(header.withColumn("_text", strip("_header")))
    titles = lineage.stored(top.filter("line_no < _first").select("path", text.alias("text")).distinct())
    data = (
        rows.filter(~ruled).join(header.select("path", "_second", "_text"), "path").filter("line_no > _second")
        .select("path", "line_no", "line", text.alias("text"), "_text").filter("text <> _text")
        .join(titles, ["path", "text"], "left_anti").select("path", "line_no", "line")
    )
    # Every row has ink, so the reports with rows are those that have some.
    shown = lineage.stored(occupancy.occupancy(data, "path"))
    headed = header.join(shown.select("path").distinct(), "path", "left_semi").select("path", F.col("_header").alias("line"))
    occupied = shown.unionByName(occupancy.occupancy(headed, "path")).groupBy("path", "word").agg(F.bit_or("bits").alias("bits"))
    inked = occupancy.ink(occupied, "path").join(header, "path").withColumn("_runs", ink_runs(F.col("ink")))
    midway = F.transform("_runs", lambda r, i: F.when(i == 0, 0).otherwise(F.floor((F.get("_runs", i - 1)["end"] + r["start"]) / 2)).cast("int"))
    columns = inked.withColumn("_spans", spans(midway)).select("path", unrepeated(_named_or_spilled(F.col("_spans"), F.col("_header"))).alias("_columns"))
    return cut_cells(data, lineage.stored(columns))


# ---------------------------------------------------------------- columns from the last rule of the header

_NEAR = 12
_RULE_MIN = 20


def is_header(text: Column) -> Column:
    """Column titles and totals repeated inside the data."""

    def all_of(*words: str) -> Column:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit & text.contains(w)
        return hit

    return (
        all_of("TRANSFER", "ACCOUNT NO") | all_of("CUSTOMER/BGL ACCT NAME") | all_of("CASH", "CLEARING", "TRANSFER")
        | all_of("CREDITS", "DEBITS") | all_of("SR_NO", "ACCT_NO") | all_of("TOT VOUCH") | all_of("TOTAL")
    )


def _rules(lines: DataFrame) -> DataFrame:
    text = strip(raw_line())
    return lines.filter(made_of(text, "- ") & (F.length(text) > _RULE_MIN)).select("path", "line_no")


def _last_near_rule(rules: DataFrame) -> DataFrame:
    """The last rule reached from the first one in steps of at most 12 lines.

    Rules are grouped in buckets of 13 lines, so a rule's successor within reach is in its
    own bucket or the next one, and no file is gathered.
    """
    size = _NEAR + 1
    near = rules.groupBy("path", F.floor(F.col("line_no") / size).alias("_b")).agg(
        F.array_sort(F.collect_list("line_no")).alias("_xs"))
    following = near.select("path", (F.col("_b") - 1).alias("_b"), F.get("_xs", F.lit(0)).alias("_next"))
    ends = F.expr(
        f"filter(_xs, (x, i) -> coalesce(get(_xs, i + 1), _next) IS NULL OR coalesce(get(_xs, i + 1), _next) - x > {_NEAR})")
    return near.join(following, ["path", "_b"], "left").groupBy("path").agg(F.min(F.get(ends, F.lit(0))).alias("_at"))


def _first_rule_under_pipes(rules: DataFrame, lines: DataFrame) -> DataFrame:
    over = lines.filter(raw_line().contains("|")).select("path", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("_piped"))
    seen = rules.join(over, ["path", "line_no"], "left")
    return seen.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("_piped"), F.col("line_no"))), F.min("line_no")).alias("_at"))


def _cut_by_rule(lines: DataFrame, target: DataFrame) -> DataFrame:
    """Columns start where the groups of the rule start, else behind the pipes or gaps of the title line over it, which names them in order."""
    heads = _near(lines, target, 1, 0)
    beside = lambda k: F.coalesce(F.get(F.filter("_near", lambda x: x["n"] == k), F.lit(0))["line"], F.lit(""))
    heads = heads.select("path", beside(0).alias("_rule"), beside(-1).alias("_title"))
    groups, piped, title = dash_runs(F.col("_rule")), cell_starts(F.col("_title")), F.col("_title")
    marks = F.when(F.size(groups) > 1, starts(groups)).when(title.contains("|") & (F.size(piped) > 1), piped).otherwise(F.concat(F.array(F.lit(0)), gap_ends(title)))
    words = F.transform(F.when(title.contains("|"), F.split(title, r"\|")).otherwise(F.split(title, " {2,}")), strip)
    words = F.when(F.length(strip(title)) > 5, F.filter(words, lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    heads = heads.withColumns({"_spans": spans(marks), "_words": words})
    name = lambda i: or_else(F.upper(F.regexp_replace(F.coalesce(F.get("_words", i), F.lit("")), r"[^\p{L}\p{N}_]", "")), F.concat(F.lit("COL_"), i.cast("string")))
    named = F.transform("_spans", lambda c, i: F.struct(name(i).alias("name"), c["start"].alias("start"), c["end"].alias("end")))
    titles = F.when(F.size("_words") > 0, F.array("_title")).otherwise(F.array().cast("array<string>"))
    columns = heads.select("path", unrepeated(named).alias("_columns"), titles.alias("_titles"))

    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    rule = made_of(F.col("text"), "-_= <>|")
    rows = ordered.after_marker(rows, rule, 2).filter(
        ~rule & ~is_header(F.col("text")) & ~F.col("text").rlike(r"[\x00-\x08\x0a-\x1f]"))

    def clean(v: Column) -> Column:
        bare = F.replace(F.replace(v, F.lit("=>"), F.lit("")), F.lit("<-"), F.lit(""))
        return strip(F.btrim(bare, F.lit("|")))

    cut = cut_cells(rows, columns, clean)
    lead = F.element_at(F.map_values("cells"), 1)
    cut = cut.filter((F.size("cells") <= 4) | ((lead != "") & ~F.upper(lead).contains("TOTAL")))
    whole = rows.join(columns, "path", "left_anti").select(
        "path", "line_no", F.create_map(F.lit("RAW_LINE"), F.col("text")).alias("cells"))
    return cut.unionByName(whole)


def ruled_columns(lines: DataFrame) -> DataFrame:
    return _cut_by_rule(lines, _last_near_rule(_rules(lines)))


def piped_ruled_columns(lines: DataFrame) -> DataFrame:
    return _cut_by_rule(lines, _first_rule_under_pipes(_rules(lines), lines))


# ---------------------------------------------------------------- grids and piped tables

#: A rule further below the first title than this does not close the header; the first row with a digit ends it then, or
#: the first title line if that row is as far.
HEADER_ROWS = 12


def _header_end(marks: DataFrame) -> DataFrame:
    """``(path, _first, _end)`` from marks (path, line_no, kind in 'rule', 'title', 'digits'): the last line of the header. It
    ends with the last rule over the first row with a digit, of the rules under the first title line."""
    first = marks.groupBy("path").agg(F.min(F.when(F.col("kind") != "rule", F.col("line_no"))).alias("_first"), F.max(F.when(F.col("kind") == "rule", F.col("line_no"))).alias("_last_rule"))
    below = marks.join(first.filter("_first is not null and _last_rule is not null"), "path").filter("line_no > _first or line_no = _last_rule")
    closes = F.coalesce(F.min(F.when((F.col("kind") == "rule") & (F.col("line_no") > F.col("_first")), F.col("line_no"))), F.max("_last_rule"))
    row = F.min(F.when((F.col("kind") == "digits") & (F.col("line_no") > F.col("_first")), F.col("line_no")))
    closed = below.groupBy("path", "_first").agg(closes.alias("_closes"), row.alias("_row"))
    late = (F.col("_closes") - F.col("_first") > HEADER_ROWS) & (F.col("_row").isNull() | (F.col("_row") < F.col("_closes")))
    ended = F.when(F.col("_row") - F.col("_first") <= HEADER_ROWS, F.col("_row") - 1).otherwise(F.col("_first"))
    closed = closed.withColumn("_closes", F.when(late, ended).otherwise(F.col("_closes"))).drop("_row")
    after = marks.join(closed, "path").filter("line_no > _closes")
    rows = after.filter("kind = 'digits'").groupBy("path").agg(F.min("line_no").alias("_row"))
    again = after.filter((F.col("kind") == "rule") & (F.col("line_no") - F.col("_closes") <= HEADER_ROWS)).join(rows, "path").filter("line_no < _row").groupBy("path").agg(F.max("line_no").alias("_again"))
    return closed.join(again, "path", "left").select("path", "_first", F.coalesce("_again", "_closes").alias("_end"))


def _marks(rows: DataFrame, rule: Column) -> DataFrame:
    return rows.select("path", "line_no", F.when(rule, "rule").when(raw_line().rlike("[0-9]"), "digits").otherwise("title").alias("kind"))


def _title_lines(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``(path, line, line_no)``: the different title lines of each header, at their first place."""
    return rows.join(ends, "path").filter("line_no <= _end").groupBy("path", "line").agg(F.min("line_no").alias("line_no"))


def grid_columns(lines: DataFrame) -> DataFrame:
    """Columns lie between the marks of a rule; each is named by the title cells that overlap it, from the top."""
    rows = without_boilerplate(lines).filter(raw_line().contains("|"))
    ruled = made_of(F.replace(raw_line(), F.lit(" "), F.lit("")), "|-+")
    marks = _marks(rows, ruled)
    ends = _header_end(marks)
    rules = rows.filter(ruled).join(ends, "path")
    rule = rules.groupBy("path").agg(F.coalesce(F.max_by("line", F.when(F.col("line_no") <= F.col("_end"), F.col("line_no"))), F.min_by("line", "line_no")).alias("_rule"))
    at = pipes(F.col("_rule"), "|+")
    limits = F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, i: F.struct(i.alias("i"), (a + 1).alias("start"), F.get(at, i + 1).alias("end")))
    limits = rule.select("path", F.inline(limits))
    titles = _title_lines(rows.filter(~ruled), ends)
    # A title cell reaches from one pipe to the next, and counts for every column that it overlaps; a line
    # counts for a column only if its pipes reach over the whole of it.
    cell_at = pipes(raw_line())
    cells = titles.filter(F.size(cell_at) > 1).select(
        "path", "line_no", F.element_at(cell_at, 1).alias("_left"), F.element_at(cell_at, -1).alias("_right"),
        F.inline(F.transform(F.slice(cell_at, 1, F.size(cell_at) - 1), lambda a, i: F.struct((a + 1).alias("from"), F.get(cell_at, i + 1).alias("to")))),
        "line").withColumn("_cell", strip(F.substring("line", F.col("from") + 1, F.col("to") - F.col("from")))).drop("line")
    cells = cells.filter((F.col("_cell") != "") & ~made_of(F.col("_cell"), "- "))
    over = limits.join(cells, "path", "left").filter(
        F.col("_cell").isNull() | ((F.col("from") < F.col("end")) & (F.col("to") > F.col("start") - 1) & (F.col("_left") < F.col("start")) & (F.col("_right") >= F.col("end"))))
    parts = over.filter("_cell is not null").groupBy("path", "i", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "_cell"))), lambda p: p["_cell"]), "_").alias("_part"))
    named = parts.groupBy("path", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", or_else(tidy(F.col("_part")), "COL").alias("part")))), lambda p: p["part"]), "_").alias("name"))
    named = limits.join(named, ["path", "i"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("COL_"), (F.col("i") + 1).cast("string"))))
    # Two columns under the same titles are one name; the rightmost wins.
    last = named.groupBy("path", "name").agg(F.max("i").alias("i"))
    columns = named.join(last, ["path", "name", "i"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "name", "start", "end"))).alias("_columns"))
    data = rows.filter(~ruled).join(ends, "path").filter("line_no > _end").join(titles.select("path", "line"), ["path", "line"], "left_anti").select("path", "line_no", "line")
    return cut_cells(data, columns, lambda v: F.rtrim(v, F.lit("|")))


def pipe_columns(lines: DataFrame) -> DataFrame:
    """Cells by their order; names from the title cells over the first rule, a name that follows itself taken once."""
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    ruled = made_of(F.col("text"), "-")
    ends = _header_end(_marks(rows.filter(ruled | raw_line().contains("|")), ruled))
    piped = rows.filter(raw_line().contains("|"))
    titles = _title_lines(piped, ends)
    cells = F.filter(F.transform(F.split("line", r"\|"), strip), lambda c: c != "")
    lined = titles.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.transform(cells, lambda c: or_else(tidy(c), "COL")).alias("names")))).alias("_lines"), F.collect_set(strip("line")).alias("_titles"))
    names = F.flatten(F.transform("_lines", lambda x: x["names"]))
    lined = lined.withColumn("_all", names).select("path", "_titles", F.filter("_all", lambda n, i: (i == 0) | (n != F.get("_all", i - 1))).alias("_names"))
    values = F.transform(F.split(F.btrim(F.col("text"), F.lit("|")), r"\|"), lambda c: F.btrim(c, F.lit(BLANKS)))
    data = piped.join(ends.select("path", "_end"), "path").filter("line_no > _end").join(lined, "path").withColumn("_cells", values)
    lead = or_else(tidy(F.get("_cells", F.lit(0))), "COL")
    data = data.filter(~F.array_contains("_titles", F.col("text")) & (lead != F.get("_names", F.lit(0))))
    # Of equal names the last column wins.
    kept = F.filter(
        F.sequence(F.lit(0), F.size("_names") - 1),
        lambda i: ~F.array_contains(F.slice("_names", i + 2, F.size("_names")), F.get("_names", i)))
    return data.select(
        "path", "line_no",
        F.map_from_arrays(
            F.transform(kept, lambda i: F.get("_names", i)),
            F.transform(kept, lambda i: F.coalesce(F.get("_cells", i), F.lit("")))).alias("cells"))
