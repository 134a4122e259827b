"""The operators as queries over the test tables; SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import (
    bpe,
    chat_format,
    conversation_repair,
    divergence,
    fingerprint,
    license_scan,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def equals(sql: str) -> Callable[[Query], Query]:
    """The SQL a query must agree with."""

    def register(function: Query) -> Query:
        SQL[function.__name__] = sql
        return function

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shards of `op9_sharding`.
SHARDS = 16


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 16, and among 17."""
    return sharding.assign(
        load(spark, sf_dir, "documents"),
        sharding.default_tree(SHARDS),
        sharding.default_tree(SHARDS + 1),
    )


URL_RULES = [
    url_filter.Rule("com/", True),
    url_filter.Rule("example.com/en/", False),
    url_filter.Rule("www.example.com/en/", True),
    url_filter.Rule("net/es/", False),
    url_filter.Rule("net/fr/", False),
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; URLs that a rule fits are the labelled ones."""
    pages = load(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict, by rules learned from the labels."""
    docs = load(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, load(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "row.doc_id", *(f"q.{name}" for name in quality_rules.BASE), "base_failed", "kept", "rule"
    )


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and likeness to that and to the next document."""
    made = fingerprint.edited(load(spark, sf_dir, "documents"))
    own, changed, after = (
        fingerprint.hashes_of(F.col(name))
        for name in ("fingerprint", "edited_fingerprint", "next_fingerprint")
    )
    return made.select(
        "*", own.alias("own"), changed.alias("changed"), after.alias("after")
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        fingerprint.resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprint.resemblance(F.col("own"), F.col("after")).alias("near_next"),
    )


#: Contract of `op8_simhash`: words in a shingle, differing bits that still link.
SIMHASH_SHINGLE, SIMHASH_DISTANCE = 4, 4


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    docs = load(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=SIMHASH_SHINGLE, distance=SIMHASH_DISTANCE)


#: Contract of `op7_substring_dedup`: words in a window.
REPEAT_WINDOW = 35


@equals(r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents
), starts as (
    select doc_id, words, unnest(range(1, len(words) - 33)) i from split where len(words) >= 35
), windows as (
    select doc_id, i, array_to_string(words[i:i + 34], ' ') w from starts
), repeated as (
    select doc_id, i from windows where w in (select w from windows group by w having count(*) > 1)
), removed as (
    select distinct doc_id, unnest(range(i, i + 35)) place from repeated
), each as (
    select doc_id, unnest(words) word, unnest(range(1, len(words) + 1)) place from split
), kept as (
    select doc_id, count(*) n, string_agg(word, ' ' order by place) line
    from each anti join removed using (doc_id, place) group by doc_id
)
select doc_id, cast(len(words) as bigint) n_words, len(words) - coalesce(n, 0) n_removed,
       sha256(coalesce(line, '')) kept_sha256
from split left join kept using (doc_id)
""")
@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur elsewhere."""
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), window=REPEAT_WINDOW)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, and the text without them as a digest."""
    docs = load(spark, sf_dir, "documents")
    model = secret_scan.train(secret_scan.planted_findings(docs), docs)
    found = secret_scan.scan(docs, model, path_column="source")
    return found.select(
        "row.doc_id",
        F.size("findings").cast("long").alias("n_findings"),
        "findings",
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence families and where they are named."""
    docs = load(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(license_scan.labelled_paragraphs(docs)))


@equals(r"""
with rows as (
    select row_number() over () n, coalesce(lang, '') lang, coalesce(source, '') source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') text
    from documents
), found as (
    select n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from rows
), vocabulary as (
    select lang, term, count(*) c from found group by all having count(distinct n) >= 3
), counts as (
    select lang, source, term, count(*) c from found semi join vocabulary using (lang, term) group by all
), groups as (
    select distinct lang, source from rows
), langs as (
    select lang, sum(c) n, count(*) v from vocabulary group by all
), sizes as (
    select lang, source, coalesce(sum(c), 0) n from groups left join counts using (lang, source) group by all
), shares as (
    select g.lang, g.source, w.term, coalesce(k.c, 0) c,
           1 + (1000000000 * (coalesce(k.c, 0)::hugeint + 1)) // (g.n + l.v)::hugeint p,
           1 + (1000000000 * (w.c::hugeint + 1)) // (l.n + l.v)::hugeint q
    from sizes g join langs l using (lang) join vocabulary w using (lang)
    left join counts k on k.lang = g.lang and k.source = g.source and k.term = w.term
), sums as (
    select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f
    from shares a join shares b using (lang, term) where a.source != b.source group by all
), pairs as (
    select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value"
    from groups a join groups b on a.lang = b.lang and a.source != b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
    select lang, source, 'term' part, term item, (((p - q) * (p - q)) // q)::bigint "value"
    from shares where c > 0 and p > q
)
select *, cast(row_number() over (partition by lang, source, part order by "value" desc, item) as int) "rank"
from (select * from pairs union all select * from terms)
qualify part = 'pair' or "rank" <= 200
""")
@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of a language's sources: how far it is from each other source, and in which terms."""
    return divergence.audit(load(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest repair, and the repaired rows as a digest."""
    rows = load(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(rows), rows)


#: A conversation that `op11_chat_format` adds to the table: control strings inside its texts.
CONTROL_STRINGS = r"\### Assistant: </turn> ok"


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted; its turns and the text under the loss mask, read back from the output."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", CONTROL_STRINGS), (-7, 1, "assistant", CONTROL_STRINGS)]
    whole = rows.union(spark.createDataFrame(added, rows.schema))
    return chat_format.read_back(chat_format.format_conversations(whole))
