"""Quality rules: word and line counts, and the divergence of a document's histograms from those of its language.

Two histograms are compared with a reference by the Jensen-Shannon distance (base 2, 0 to 1): the share of character
classes, and the share of the language's common words among all words. A reference is the mean histogram of all documents
of that language with enough words. One pass over the texts makes a narrow table of counts, which is stored in the shared
folder; references and verdicts come from that table. Everything is column expressions.

Defined cases: a null text is empty and has no words, so it fails the base rules; a document in an unknown or null language,
or with fewer words than ``least_words``, is judged by the base rules alone, because its histogram is noise; repeated rows are
judged alike; an empty table gives an empty one; columns of the input other than id, text and language do not enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Frequent function words of each known language.
COMMON = {
    "de": "der die das und zu den mit von ist im ein eine nicht auf für dem".split(),
    "en": "the of and to in a is that for it as was with on be by".split(),
    "es": "de la que el en y a los del se las por un para con su".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au".split(),
}

#: Character classes of what is left of a text without a-z and spaces, each by the characters that it does not take.
CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "point": r"[^.,;:!?'\"()\-]+",
    "symbol": r"[^#*$%&|<>@\\^_`~{}\[\]+=/]+",
    "beyond": r"[\x00-\x7F]+",
}

#: A histogram is judged from so many words on.
LEAST_WORDS = 100
#: Largest distance of character classes, and of common words: the latter for very long texts, and what is allowed on top
#: of it for chance, divided by the square root of the number of words.
MOST_CLASSES, MOST_COMMON, CHANCE = 0.28, 0.15, 1.2

_PLACE_BITS = 28  # of a sort key: the window's place; the rest is the upper part of its hash


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _total(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _only(text: Column | str, pattern: str) -> Column:
    """How many characters are left without those of the pattern."""
    return _long(F.length(F.regexp_replace(text, pattern, "")))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base counts, ``base_failed`` and the two histograms ``class_counts`` and ``common_counts`` (null in an
    unknown language); the last entry of each is the rest. Three-word windows are compared by their 64-bit hashes: sorted as
    one number with the place below the hash, equal ones are neighbours."""
    body = F.coalesce(F.col(text), F.lit(""))
    flat = body
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    df = docs.withColumn("_flat", flat)
    df = df.withColumns({
        "_words": F.array_remove(F.split("_flat", " "), ""), "word_chars": _long(F.length(F.replace("_flat", F.lit(" "), F.lit("")))),
        "_chars": _long(F.length("_flat")), "_rest": F.regexp_replace(body, "[a-z ]+", ""),
        "_lines": F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))),
    })
    every = sorted({w for words in COMMON.values() for w in words})
    df = df.withColumns({
        "n_words": _long(F.size("_words")), "n_symbols": _only("_rest", r"[^#*$%&|<>]+"),
        "n_dup_lines": _long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "class_counts": F.array(*[_only("_rest", p) for p in CLASSES.values()], F.col("_chars") - F.col("word_chars")),
        "_found": F.filter("_words", lambda w: w.isin(every)),
    })
    at = lambda k: F.get("_words", k)
    grams = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda k: F.xxhash64(at(k), at(k + 1), at(k + 2)))
    times = lambda w: _long(F.size("_found") - F.size(F.array_remove("_found", w)))
    own = F.coalesce(*[F.when(F.col(lang) == k, F.array(*[times(w) for w in words])) for k, words in COMMON.items()])
    df = df.withColumns({
        "class_counts": F.concat("class_counts", F.array(F.col("_chars") - _total("class_counts"))), "common_counts": own,
        "_grams": F.when(F.col("n_words") >= 3, grams).otherwise(F.array().cast("array<bigint>")),
    })
    df = df.withColumns({
        "common_counts": F.concat("common_counts", F.array(F.col("n_words") - _total("common_counts"))),
        "_keys": F.sort_array(F.transform("_grams", lambda h, k: F.shiftleft(h, _PLACE_BITS).bitwiseOR(_long(k)))),
    })
    top = lambda x: F.shiftrightunsigned(x, _PLACE_BITS)
    near = lambda x, k, d: F.coalesce(top(F.get("_keys", k + d)) == top(x), F.lit(False))
    df = df.withColumn("_keys", F.filter("_keys", lambda x, k: near(x, k, -1) | near(x, k, 1)))
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    gram = lambda x: F.get("_grams", place(x))
    same = lambda x, k, d: F.coalesce(gram(F.get("_keys", k + d)) == gram(x), F.lit(False))
    df = df.withColumn("_keys", F.filter("_keys", lambda x, k: same(x, k, -1) | same(x, k, 1) | same(x, k, -2) | same(x, k, 2)))
    df = df.withColumn("_keys", F.sort_array(F.transform("_keys", place)))
    covered = F.transform("_keys", lambda p, k: _long(F.least(F.coalesce(F.get("_keys", k + 1) - p, F.lit(3)), F.lit(3))))
    df = df.withColumn("n_repeat_words", _total(covered))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_flat", "_words", "_chars", "_rest", "_lines", "_found", "_grams", "_keys")


def references(measures: DataFrame, lang: str = "lang", least_words: int = LEAST_WORDS) -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares of character classes and of common words: one row for each known language."""
    n_class, n_word = len(CLASSES) + 2, len(next(iter(COMMON.values()))) + 1
    means = [F.avg(F.get("class_counts", F.lit(k)) / _total("class_counts")).alias(f"c{k}") for k in range(n_class)]
    means += [F.avg(F.get("common_counts", F.lit(k)) / F.col("n_words")).alias(f"w{k}") for k in range(n_word)]
    rows = measures.filter(F.col(lang).isin(sorted(COMMON)) & (F.col("n_words") >= least_words)).groupBy(lang).agg(*means).collect()
    return {r[lang]: ([r[f"c{k}"] for k in range(n_class)], [r[f"w{k}"] for k in range(n_word)]) for r in rows}


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts to a reference of shares."""

    def part(n: Column, q: Column) -> Column:
        p = n / total
        half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
        return half(p) + half(q)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(counts, reference, part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def verdicts(measures: DataFrame, lang: str = "lang", least_words: int = LEAST_WORDS, most_classes: float = MOST_CLASSES,
             most_common: float = MOST_COMMON, chance: float = CHANCE) -> DataFrame:
    """Adds ``class_gap``, ``common_gap`` (null where none is taken) and ``kept`` to what ``measured`` gives."""
    known = references(measures, lang, least_words)

    def reference(j: int) -> Column:
        return F.coalesce(F.lit(None).cast("array<double>"), *[F.when(F.col(lang) == k, F.array(*map(F.lit, r[j]))) for k, r in known.items()])

    enough = F.col("n_words") >= least_words
    df = measures.withColumns({
        "class_gap": F.when(enough, js_distance(F.col("class_counts"), _total("class_counts"), reference(0))),
        "common_gap": F.when(enough, js_distance(F.col("common_counts"), F.col("n_words"), reference(1))),
    })
    odd = (F.col("class_gap") > most_classes) | (F.col("common_gap") > most_common + chance / F.sqrt("n_words"))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The key, the base counts, the histograms, the distances and ``kept`` of each row."""
    return verdicts(stored(measured(docs.select(key, text, lang), text, lang).drop(text), "measures"), lang)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns. Rejected rows are met again by key, language and text hash."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    measures = stored(measured(docs.select(key, text, lang), text, lang).withColumn("_mark", mark).drop(text), "measures")
    out = verdicts(measures, lang).filter("not kept").select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), "_mark").distinct()
    same = docs[key].eqNullSafe(out["_key"]) & docs[lang].eqNullSafe(out["_lang"]) & (mark == out["_mark"])
    return docs.join(out, same, "left_anti")


def judge_sql() -> str:
    """The same counts and verdicts over ``documents``, windows grouped by their words, as SQL."""
    words = "list_filter(string_split_regex(body, '[ \\t-\\r]+'), lambda x: x <> '')"
    rest = "regexp_replace(body, '[a-z ]+', '', 'g')"
    quoted = lambda p: p.replace("'", "''")
    counts = ", ".join(f"length(regexp_replace({rest}, '{quoted(p)}', '', 'g'))" for p in CLASSES.values())
    lists = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON.items())
    gap = """sqrt(greatest(list_sum(list_transform(range(1, len({c}) + 1), lambda k:
        case when {c}[k] > 0 then {c}[k] / {n} * log2(2 * ({c}[k] / {n}) / ({c}[k] / {n} + {r}[k])) else 0 end
        + case when {r}[k] > 0 then {r}[k] * log2(2 * {r}[k] / ({c}[k] / {n} + {r}[k])) else 0 end)) / 2, 0))"""
    mean = "[{}]"
    n_class, n_word = len(CLASSES) + 2, len(next(iter(COMMON.values()))) + 1
    class_means = mean.format(", ".join(f"avg(classes[{k}] / chars)" for k in range(1, n_class + 1)))
    word_means = mean.format(", ".join(f"avg(common[{k}] / n_words)" for k in range(1, n_word + 1)))
    return rf"""
    with texts as (select doc_id, lang, coalesce(text, '') as body from documents),
    split as (select doc_id, lang, body, {words} as words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as lines, [{counts}] as parts from texts),
    base as (
      select doc_id, lang, body, words, len(words)::bigint as n_words, list_sum(list_transform(words, lambda w: length(w)))::bigint as chars_of_words,
        length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        length(body)::double as chars, parts, case lang {lists} end as listed from split),
    counted as (
      select *, list_concat(parts, [length(body) - coalesce(chars_of_words, 0)]) as known,
        list_transform(listed, lambda w: len(list_filter(words, lambda x: x = w))) as found from base),
    filled as (
      select *, list_concat(known, [length(body) - list_sum(known)]) as classes, list_concat(found, [n_words - list_sum(found)]) as common from counted),
    windows as (
      select doc_id, k, words[k] as a, words[k + 1] as b, words[k + 2] as c
      from (select doc_id, words, unnest(range(1, n_words - 1)) as k from base where n_words >= 3)),
    again as (select doc_id, k from windows qualify count(*) over (partition by doc_id, a, b, c) > 1),
    covered as (select doc_id, count(distinct k + d)::bigint as n from again, range(3) r(d) group by doc_id),
    means as (select lang, {class_means} as class_ref, {word_means} as word_ref from filled where n_words >= {LEAST_WORDS} and listed is not null group by lang),
    judged as (
      select f.*, coalesce(c.n, 0)::bigint as n_repeat_words, class_ref, word_ref from filled f left join covered c using (doc_id) left join means m on f.lang = m.lang),
    failed as (
      select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when n_words >= {LEAST_WORDS} and class_ref is not null then {gap.format(c='classes', n='chars', r='class_ref')} end as class_gap,
        case when n_words >= {LEAST_WORDS} and word_ref is not null then {gap.format(c='common', n='n_words', r='word_ref')} end as common_gap
      from judged)
    select doc_id, n_words, coalesce(chars_of_words, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and not coalesce(class_gap > {MOST_CLASSES} or common_gap > {MOST_COMMON} + {CHANCE} / sqrt(n_words), false) as kept
    from failed"""
