"""Secrets in texts, told apart by who holds them across the corpus; DataFrame functions only.

Every whole text is searched for candidates: assignments to names such as ``password``, access key ids, long hexadecimal runs, opaque
tokens (long runs of small letters, capitals and digits) and passwords in connection strings. The value of each candidate is kept
as a SHA-256 hash only. For every hash the corpus is asked how many distinct owners, and how many distinct repositories of
those, hold it: a value that more than ``MAX_OWNERS`` owners or ``MAX_REPOSITORIES`` repositories hold is a widely copied example, any other
belongs to its owner and looks live. Assignments, access keys and hexadecimal runs are always reported, with that verdict;
opaque tokens and connection strings are reported only where they look live and touch no other span.

Counting is three aggregates with partial sums, (hash, owner, repository), (hash, owner), (hash), so a value on a third of all rows is counted
in small parts. Spans are judged once for each distinct text and joined back by the hash of the text; both joins are plain equi-joins,
whose skewed keys adaptive execution splits. Texts without candidates take part in no shuffle.

Defined cases: a NULL text is an empty one. A NULL owner or repository counts as one unknown owner or repository. Repeated rows give
repeated results and count once. Positions are in code points, ends exclusive; matches of one kind never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

MAX_OWNERS = 2
MAX_REPOSITORIES = 100

#: Names, formats and least lengths. Each kind has its pattern, the group that holds the value, and what a match must satisfy.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in NAMES)
ASSIGN = rf"""({ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
DSN = r"://[^\x00-\x20:/@]+:([^\x00-\x20/@]+)@"
BASE = ("assign", "access", "hex")
ADDED = ("opaque", "dsn")
KINDS = BASE + ADDED
CHUNK = 256

NO_MATCH = "cast(array() as array<struct<start:int,`end`:int,m:string>>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lengths(text: str, found: str, pattern: str) -> str:
    """SQL for the length of the piece before each match and of the match, NULL without matches."""
    pieces = f"zip_with(split({text}, {_quoted(pattern)}, -1), {found}, (p, m) -> named_struct('gap', char_length(p), 'size', char_length(m), 'm', m))"
    return f"CASE WHEN size({found}) > 0 THEN slice({pieces}, 1, size({found})) END"


def _chunks(lengths: str) -> str:
    return f"transform(sequence(0, (size({lengths}) - 1) div {CHUNK}), i -> slice({lengths}, i * {CHUNK} + 1, {CHUNK}))"


def _placed(chunks: str) -> str:
    """SQL for (start, end, match) of each match: the lengths summed up, chunk by chunk, so that no long array is copied for each match."""
    starts = (f"aggregate({chunks}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, c) -> named_struct("
              "'at', acc.at + aggregate(c, 0, (s, x) -> s + x.gap + x.size), 'out', concat(acc.out, array(acc.at))), acc -> acc.out)")
    inner = (f"aggregate(c, named_struct('at', o, 'out', {NO_MATCH}), (acc, x) -> named_struct('at', acc.at + x.gap + x.size, 'out', "
             "concat(acc.out, array(named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + x.size, 'm', x.m)))), acc -> acc.out)")
    return f"flatten(zip_with({chunks}, {starts}, (c, o) -> {inner}))"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``key`` (128 bits of the text) and ``candidates`` (start, kind, end, value) of the text.

    ``kind`` is a position in ``KINDS``. A match of an added kind that touches one of the base kinds is left out.
    """
    searched = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE, DSN)))
    value = {"assign": f"regexp_extract(x.m, {_quoted(ASSIGN)}, 2)", "dsn": f"regexp_extract(x.m, {_quoted(DSN)}, 1)"}
    holds = {"assign": f"char_length({value['assign']}) >= 8", "dsn": f"char_length({value['dsn']}) >= 8",
             "opaque": "x.m rlike '[a-z]' AND x.m rlike '[A-Z]' AND x.m rlike '[0-9]'"}
    row = [c for c in docs.columns if c != text]
    step = docs.select(F.struct(*row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    step = step.select("row", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in searched.items()])
    step = step.select("row", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("key"),
                       *[F.expr(_lengths("text", k, p)).alias(k) for k, p in searched.items()])
    for sql in (_chunks, _placed):
        step = step.select("row", "key", *[F.expr(f"CASE WHEN {k} IS NOT NULL THEN {sql(k)} END").alias(k) for k in KINDS])
    kept = {k: (f"transform(filter(coalesce({k}, {NO_MATCH}), x -> {holds.get(k, 'true')}), x -> "
                f"named_struct('start', x.start, 'kind', {at}, 'end', x.`end`, 'value', sha2({value.get(k, 'x.m')}, 256)))")
            for at, k in enumerate(KINDS)}
    step = step.select("row", "key", F.expr(f"concat({', '.join(kept[k] for k in BASE)})").alias("base"),
                       F.expr(f"concat({', '.join(kept[k] for k in ADDED)})").alias("added"))
    free = "filter(added, x -> NOT exists(base, y -> x.start < y.`end` AND y.start < x.`end`))"
    return step.select("row.*", "key", F.expr(f"array_sort(concat(base, {free}))").alias("candidates"))


def ownership(uses: DataFrame) -> DataFrame:
    """(value, owners, repositories) from rows (value, owner, repository); repositories of one name under two owners are two."""
    return (uses.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
            .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
            .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")))


def scan(docs: DataFrame, owner: Column, repository: Column, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
         max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The kept columns and ``spans``: (start, kind, end, value, owners, repositories, copied), by start and kind, of each row of ``docs``."""
    source = docs.select(F.struct(*keep).alias("kept"), owner.alias("owner"), repository.alias("repository"), F.col(text).alias("text"))
    found = staged(candidates(source), "candidates")
    some = found.filter(F.size("candidates") > 0)
    each = some.select("key", "owner", "repository", F.inline("candidates"))
    held = ownership(each.select("value", "owner", "repository"))
    judged = (each.select("key", "start", "kind", "end", "value").distinct().join(held, "value")
              .withColumn("copied", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
              .filter((F.col("kind") < len(BASE)) | ~F.col("copied")))
    spans = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "value", "owners", "repositories", "copied"))).alias("spans"))
    joined = some.select("kept", "key").join(spans, "key", "left").select("kept", "spans")
    none = F.array().cast(spans.schema["spans"].dataType)
    rest = found.filter(F.size("candidates") == 0).select("kept", none.alias("spans"))
    return joined.unionAll(rest).select("kept.*", F.coalesce("spans", none).alias("spans"))


def digest(spans: str = "spans") -> dict[str, Column]:
    """Columns of a report: counts of the base kinds, their digest, all spans as text, and how many look live or copied."""
    names = "element_at(array({}), x.kind + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    told = f"concat_ws(':', {names}, x.start, x.`end`)"
    base = f"array_join(transform(filter({spans}, x -> x.kind < {len(BASE)}), x -> {told}), ',')"
    counts = {f"n_{k}": F.expr(f"cast(size(filter({spans}, x -> x.kind = {at})) as bigint)") for at, k in enumerate(BASE)}
    return counts | {
        "base_sha256": F.sha2(F.expr(base), 256), "spans": F.expr(f"array_join(transform({spans}, x -> {told}), ',')"),
        "n_live": F.expr(f"cast(size(filter({spans}, x -> NOT x.copied)) as bigint)"),
        "n_copied": F.expr(f"cast(size(filter({spans}, x -> x.copied)) as bigint)")}
