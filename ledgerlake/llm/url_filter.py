"""URL filtering by domain rules and by pattern rules that are indexed under their rarest literal token.

All of it is column expressions: no shuffle, no Python in the tasks. Rules are an argument, so their index is a constant
array of buckets; a token of a URL reads one bucket, and only the patterns it finds there are run on that URL.

Defined cases: a null URL or one without ``://`` has an empty host and path (and can still meet a pattern); an empty table
gives an empty one; repeated rows are judged alike; columns of the input other than the URL are kept unless their names
are those of the result, which then replace them."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocked patterns: ``^`` is any separator or the end of the URL, ``*`` any run of characters, the rest is literal.
PATTERNS = {
    "spam farm": "^spam-farm^",
    "pills": "^cheap-pills^",
    "casino": "^casino^",
    "adult": "^adult^*^",
    "link farm": "^link-farm^",
    "advert server": "^ads.*^",
    "advert path": "/adserver/*^",
    "tracking pixel": "^pixel.gif^",
    "session": "^phpsessid=*^",
}

#: (rule, verdict): a host and the beginning of a path.
DOMAINS = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern_regex(pattern: str) -> str:
    """The regular expression of a rule, for a URL with a-z in place of A-Z."""
    made = ""
    for k, c in enumerate(pattern.lower()):
        if c == "^":
            made += "(?:^|[^a-z0-9])" if k == 0 else "(?:[^a-z0-9]|$)"
        else:
            made += ".*" if c == "*" else c if c.isalnum() else re.sub(r"([^a-z0-9_/=&-])", r"\\\1", c)
    return "(?s)" + made


def pattern_tokens(pattern: str) -> list[str]:
    """The literal words of a rule that are whole words in every URL it fits."""
    return [m[1] for m in re.finditer(r"(?<![a-z0-9*])(?<!^)([a-z0-9]+)(?![a-z0-9*])(?!$)", pattern.lower())]


def lowered(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(url), "[^a-z0-9]+"))


def rarest_tokens(pages: DataFrame, patterns: dict[str, str], url: str = "url") -> dict[str, str]:
    """The index token of each rule: of its literal tokens the one in the fewest URLs, the first by name among equals.
    One pass; only counts of the rules' own tokens come back."""
    tokens = {name: pattern_tokens(p) for name, p in patterns.items()}
    if lacking := [name for name, found in tokens.items() if not found]:
        raise ValueError(f"rules without a whole literal word: {lacking}")
    wanted = sorted({t for found in tokens.values() for t in found})
    seen = pages.select(F.explode(F.filter(url_tokens(F.col(url)), lambda t: t.isin(wanted))).alias("token")).groupBy("token").count()
    count = {r["token"]: r["count"] for r in seen.collect()}
    return {name: min(found, key=lambda t: (count.get(t, 0), t)) for name, found in tokens.items()}


def _buckets(entries: Iterable[tuple[str, dict]], fields: str) -> tuple[Column, int]:
    """Entries under the checksum of their key, as a constant array of arrays."""
    entries = list(entries)
    size = max(1, 2 * len(entries))
    table: list[list[dict]] = [[] for _ in range(size)]
    for key, entry in entries:
        table[zlib.crc32(key.encode()) % size].append({"key": key, **entry})
    return F.from_json(F.lit(json.dumps(table)), f"array<array<struct<key:string,{fields}>>>"), size


def _look_up(keys: Column, index: Column, size: int) -> Column:
    def found(key: Column) -> Column:
        return F.filter(F.element_at(index, (F.crc32(key) % size + 1).cast("int")), lambda r: r["key"] == key)

    return F.flatten(F.transform(keys, found))


def judge(pages: DataFrame, patterns: dict[str, str] = PATTERNS, domains: list[tuple[str, str]] = DOMAINS, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the longest fitting domain rule or null), ``pattern`` (the first fitting pattern
    by name or null) and ``verdict``: the domain rule's, else block for a fitting pattern, else allow."""
    key = rarest_tokens(pages, patterns, url) if patterns else {}
    index, size = _buckets(((key[n], {"name": n, "regex": pattern_regex(p)}) for n, p in patterns.items()), "name:string,regex:string")
    rules, n_rules = _buckets(((r.partition("/")[0], {"path": "/" + r.partition("/")[2], "rule": r, "verdict": v}) for r, v in domains), "path:string,rule:string,verdict:string")
    text, whole = F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    out = pages.withColumns({"host": F.translate(F.regexp_extract(text, whole, 1), UPPER, LOWER), "path": F.regexp_extract(text, whole, 2)})
    labels = F.split("host", r"\.")
    ends = F.transform(labels, lambda _, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    fitting = F.filter(_look_up(ends, rules, n_rules), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    hits = F.filter(_look_up(url_tokens(F.col(url)), index, size), lambda r: F.rlike(lowered(F.col(url)), r["regex"]))
    out = out.withColumns({"_rule": best, "pattern": F.array_min(F.transform(hits, lambda r: r["name"]))})
    fallback = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), fallback)}).drop("_rule")


def judge_sql(patterns: dict[str, str] = PATTERNS, domains: list[tuple[str, str]] = DOMAINS) -> str:
    """The same judgement with every pattern run on every URL, as SQL."""
    lists = ", ".join(f"({n!r}, {pattern_regex(p)!r})" for n, p in patterns.items()).replace("\\\\", "\\")
    rules = ", ".join(f"({r!r}, {r.partition('/')[0]!r}, {'/' + r.partition('/')[2]!r}, {v!r})" for r, v in domains)
    return rf"""
    with parts as (
      select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as low,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
      from pages),
    patterns(name, regex) as (values {lists}),
    rules(rule, rule_host, rule_path, verdict) as (values {rules}),
    judged as (
      select p.*, (select max_by(struct_pack(rule := rule, verdict := verdict), struct_pack(n := length(rule), r := rule)) from rules
          where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as best,
        (select min(name) from patterns where regexp_matches(low, regex)) as pattern
      from parts p)
    select page_id, host, path, best.rule as rule, pattern, coalesce(best.verdict, case when pattern is null then 'allow' else 'block' end) as verdict
    from judged"""
