"""The operators bound to the driver tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import bpe, chat, digests, jaccard, langid, mixing, neighbours, packing, passages, periodic, pii, resample, sharding
from evidex.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = tuple(f"shard-{k:03d}" for k in range(100))


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, read)``, where ``read(table)`` reads a table of the driver."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_packing")
def packing_query(spark, read):
    return packing.pack(read("documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query("op2_language_id")
def language_query(spark, read):
    docs = read("documents")
    learned = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, learned).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_tool_calls", """
with calls as (
  select conv_id, turn, conv_id || ':' || turn as call_id, role,
         case when role = 'system' then 'configure' else 'ask' end as tool, text
  from conversations where role <> 'assistant'),
edges as (
  select c.conv_id, c.turn, p.turn as parent from calls c join calls p
  on c.conv_id = p.conv_id and p.turn between c.turn - 2 and c.turn - 1),
levels as (
  with recursive walk(conv_id, turn, level) as (
    select conv_id, turn, 0 from calls where (conv_id, turn) not in (select (conv_id, turn) from edges)
    union all select e.conv_id, e.turn, w.level + 1 from walk w join edges e on e.conv_id = w.conv_id and e.parent = w.turn)
  select conv_id, turn, max(level)::int as level from walk group by all),
results as (select conv_id, turn - 1 as turn, text from conversations where role = 'assistant')
select c.conv_id, c.call_id, row_number() over (partition by c.conv_id order by l.level, c.call_id) - 1 as position, l.level, c.tool,
       length(c.text) >= 1 as valid, case when length(c.text) >= 1 then '' else 'chars: too small' end as problems, r.text is not null as answered,
       '{"arguments":{"chars":' || length(c.text) || ',"text":' || to_json(c.text) || ',"turn":' || c.turn || '},"call_id":"' || c.call_id
       || '","name":"' || c.tool || '","result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as message
from calls c join levels l using (conv_id, turn) left join results r using (conv_id, turn)
""")
def tool_call_query(spark, read):
    """Turns other than the assistant's are calls, which wait for those of the two turns before; the assistant's answer the turn before."""
    turns = read("conversations")
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    turn = F.col("turn")
    arguments = F.to_json(F.struct("turn", "text", F.length("text").alias("chars")))
    calls = turns.filter("role <> 'assistant'").select(
        "conv_id", name(turn).alias("call_id"), F.when(F.col("role") == "system", "configure").otherwise("ask").alias("tool"),
        arguments.alias("arguments"), F.array(name(turn - 1), name(turn - 2)).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    schemas = spark.createDataFrame([(t, p, k, True, m) for t in ("ask", "configure") for p, k, m in (("chars", "integer", 1.0), ("text", "string", None), ("turn", "integer", 0.0))],
                                    "tool string, param string, type string, required boolean, minimum double")
    return chat.link(calls, results, schemas)


@query("op4_sharding")
def sharding_query(spark, read):
    return sharding.place(read("documents").select("doc_id"), SHARDS)


@query("op5_exact_dedup", """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
""")
def exact_dedup_query(spark, read):
    """All documents in two batches against one index, which goes once it has been filled."""
    index = digests.DigestIndex(spark)
    found = index.dedup_all(read("documents"))
    index.drop()
    return found


@query("op6_personal_data")
def personal_data_query(spark, read):
    found = pii.detect(read("documents"), pii.trained(spark))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


@query("op7_passages")
def passages_query(spark, read):
    return passages.cut(read("documents"), with_text=False)


@query("op8_neighbours")
def neighbours_query(spark, read):
    return neighbours.search(read("embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op9_byte_pairs")
def byte_pairs_query(spark, read):
    return bpe.token_digests(read("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op10_jaccard_classes")
def jaccard_query(spark, read):
    return jaccard.classes(read("documents"))


@query("op11_importance_resampling", r"""
with words as (
  select 'd' as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
seen as (select side, f, count(*) as n from (select side, unnest(w) as f from words) group by all),
coded as (select f, hex(encode(f)) as x from (select distinct f from seen)),
bytes as (select f, list_transform(range(1, (length(x) // 2 + 1)::bigint), lambda i: ('0x' || substr(x, (2 * i - 1)::int, 2))::bigint) as b from coded),
bucketed as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda z, k:
    case when z % 2 = 1 then xor(z // 2, 3988292384::bigint) else z // 2 end)), 4294967295::bigint) % 10000 as bucket from bytes),
counts as (
  select bucket, sum(case when side = 'd' then n else 0 end)::double as s, sum(case when side = 'b' then n else 0 end)::double as t
  from seen join bucketed using (f) group by bucket),
totals as (select coalesce(sum(s), 0) as all_s, coalesce(sum(t), 0) as all_t from counts),
gain as (
  select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as g from counts, totals),
weighed as (
  select doc_id, count(f) as n_features, coalesce(sum(g), 0)::bigint as weight
  from (select doc_id, unnest(case when len(w) = 0 then [null] else w end) as f from words where side = 'd')
  left join bucketed using (f) left join gain using (bucket) group by doc_id),
scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score from weighed),
ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
         count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from ranked
""")
def resampling_query(spark, read):
    drawn = resample.draw(read("documents"), read("benchmark"), percent=10, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_source_mixing")
def mixing_query(spark, read):
    mixed = mixing.mix(read("documents"), weights=(1, 2, 3))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op13_periodic_runs")
def periodic_query(spark, read):
    return periodic.digests(periodic.planted(read("documents")))
