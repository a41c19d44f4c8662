"""Secret scans through a trigram inverted index.

Each rule is a regular expression.  From its syntax tree a Boolean trigram
query is derived that every match fulfils (``regex_grams``).  The index holds
the postings of the trigrams that the queries ask for: documents have a slot in
a bucket of ``SLOTS``, and a posting list is one bitmap per trigram and bucket.
The bitmaps of a conjunction are intersected, those of the conjunctions of a
rule united; what is left are the candidates of the rule.  They alone are
verified with the expression.  Rules without mandatory trigrams are run over
every text.

Two documents may share a slot.  They are then candidates together and the
verification parts them, so slots cost work, never results.

Everything is built-in functions.  Texts are read twice, for the index and for
the verification, and are not shuffled while the candidates are few enough to
broadcast, which is counted.  A bucket holds ``LOAD`` documents on average
whatever the size of the table; repeated rows are folded before they are dealt
to buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.regex_grams import ANY, trigram_query
from tidemark.llm.tables import shared_if_small, stored, whole_text

SLOTS = 32_768  # bits of a bitmap
LOAD = 1024


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` has at least ``least`` letters.

    A match that is too short is dropped after it was found: the search goes on behind it.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """An expression for an ASCII word in upper and lower case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

BASE_RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run of these letters is matched as a whole or not at all, so the least length can stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D/@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_entries(texts: DataFrame, grams: list[str], buckets: int) -> DataFrame:
    """(bucket, slot, grams) of (id, text): the numbers of the trigrams in the lower-cased text, one row per slot and set."""
    low = texts.select(*slot_of(buckets), F.lower("text").alias("low"))  # by itself, so that it is computed once
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    return low.select("bucket", "slot", there.alias("grams")).distinct()


def slot_of(buckets: int) -> list[Column]:
    """Bucket and slot of a row (id, text); the same in every pass."""
    place = F.xxhash64("id", "text")
    return [F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.shiftrightunsigned(place, 32), F.lit(SLOTS)).cast("int").alias("slot")]


def postings(entries: DataFrame) -> DataFrame:
    """(bucket, gram, bits): the inverted index, partitioned by bucket."""
    dealt = entries.repartition("bucket").select("bucket", "slot", F.explode("grams").alias("gram"))
    return dealt.groupBy("bucket", "gram").agg(F.bitmap_construct_agg("slot").alias("bits"))


def intersected(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(bucket, rule, bits) of the slots that fulfil one of the conjunctions of a rule.

    ``asked`` has a row (rule, conjunction, size, gram) per trigram of a
    conjunction; it comes from the rules alone and is small.
    """
    met = index.join(F.broadcast(asked), "gram").groupBy("bucket", "rule", "conjunction", "size")
    whole = met.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where("n = size")
    return whole.groupBy("bucket", "rule").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit(bits: Column, slot: Column) -> Column:
    """Whether a slot is set in a bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, slot % 8) == 1


def candidates(texts: DataFrame, queries: dict[int, frozenset], buckets: int) -> DataFrame:
    """(bucket, slot, rules): per slot the rules whose query holds."""
    spark = texts.sparkSession
    grams = sorted({g for query in queries.values() for conjunction in query for g in conjunction})
    number = {g: k for k, g in enumerate(grams)}
    rows = []
    for rule, query in queries.items():
        for k, conjunction in enumerate(sorted(query, key=sorted)):
            rows += [(rule, k, len(conjunction), number[g]) for g in conjunction]
    asked = spark.createDataFrame(rows, "rule int, conjunction int, size long, gram int")
    entries = stored(trigram_entries(texts, grams, buckets), "secret-entries")
    found = stored(intersected(postings(entries), asked), "secret-hits")
    hit = entries.select("bucket", "slot").distinct().join(found, "bucket").where(bit(F.col("bits"), F.col("slot")))
    return hit.groupBy("bucket", "slot").agg(F.collect_set("rule").alias("rules"))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rule:int,kind:string,end:int,secret:string>>")


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rule, kind, end, secret) of a rule's matches, in code points, end exclusive.

    The pieces between the matches and the matches themselves give the places.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    matches = F.regexp_extract_all(text, pattern, 0)
    judged = F.regexp_extract_all(text, pattern, rule.group)
    rows = F.zip_with(F.zip_with(lengths, matches, lambda a, m: F.struct(a.alias("gap"), m.alias("m"))), judged, lambda a, g: F.struct(a.gap.alias("gap"), a.m.alias("m"), g.alias("g")))
    empty = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def add(state: Column, row: Column) -> Column:
        start = state.at + row.gap
        end = start + F.coalesce(F.length(row.m), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"), end.alias("end"), row.m.alias("secret"))
        fits = row.m.isNotNull() & (F.length(row.g) >= rule.least)
        return F.struct(end.alias("at"), F.when(fits, F.array_append(state.found, span)).otherwise(state.found).alias("found"))

    found = F.aggregate(rows, empty, add, lambda state: state.found)
    return F.when(text.rlike(rule.pattern), found).otherwise(no_spans())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and spans, an array of (start, rule, kind, end, secret).

    Spans are in code points, end exclusive, by start and then by the order of
    the rules; those of one rule do not overlap.  Null texts are empty and
    empty texts give no spans; long texts are searched whole.  Rows with null
    or repeated identifiers are rows like any other.  Other columns are not
    read; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    queries = {k: trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    indexed = {k: query for k, query in queries.items() if query != ANY}
    if indexed:
        buckets = 1 + texts.count() // LOAD
        known = shared_if_small(stored(candidates(texts, indexed, buckets), "secret-candidates"))
        texts = texts.withColumns({c: x for c, x in zip(("bucket", "slot"), slot_of(buckets), strict=True)}).join(known, ["bucket", "slot"], "left")
    found = []
    for k, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, k)
        found.append(F.when(F.array_contains("rules", k), spans).otherwise(no_spans()) if k in indexed else spans)
    return texts.select(F.col("id").alias(id_col), F.array_sort(F.concat(*found)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def scan_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> str:
    """The result of the query in DuckDB SQL: every rule run over every text, without an index."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""select id, {k} as rule, '{rule.kind}' as kind, unnest(regexp_extract_all(body, '{pattern}')) as m,
       unnest(regexp_extract_all(body, '{pattern}', {rule.group})) as g, {rule.least} as least,
       unnest(string_split_regex(body, '{pattern}')[:len(regexp_extract_all(body, '{pattern}'))]) as gap,
       generate_subscripts(regexp_extract_all(body, '{pattern}'), 1) as i from texts where regexp_matches(body, '{pattern}')"""
        )
    return f"""
with texts as (select row_number() over () as id, doc_id, coalesce(text, '') as body from documents),
found as ({" union all ".join(parts)}),
placed as (
  select *, cast(sum(length(gap) + length(m)) over (partition by id, rule order by i) as bigint) as stop from found),
spans as (select id, rule, kind, stop - length(m) as start, stop from placed where length(g) >= least),
joined as (
  select id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rule) filter (rule < {base}) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rule) as spans
  from spans group by id)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (id)
"""
