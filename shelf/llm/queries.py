"""The registered queries of the operators, thin over the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelf.llm import common, decontam, dialogue, fim, hmm, langid, licenses, mixing, quality, repeats, sharding, simhash, urls, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The word pattern as DuckDB writes it.
WORD = r"[^\x20\x09-\x0D]+"


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing", f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '')) as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from s),
f as (select *, 3 * source_size::double as most, 3 * source_size / weight as fill from w),
r as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as rate
  from f),
t as (
  select source, source_size,
    least(case when fill <= rate then most else coalesce(weight * (select arg_min(rate, fill) from r where fill > rate), most) end, most) as target
  from r),
b as (select *, least(round(target)::bigint, 3 * source_size) as budget from t),
p as (
  select d.doc_id, d.size, b.*, case when b.source_size > 0 then budget // b.source_size else 0 end as copies,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
  (copies * size + greatest(0, least(size, budget - copies * source_size - ahead)))::bigint as taken
from p
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("words"))
    return mixing.mix(docs, F.col("words")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("same_text")
    )
    return sharding.assign(docs, F.col("same_text")).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


@query("op3_quality_rules", f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as nr from documents),
w as (select nr, regexp_extract_all(text, '{WORD}') as ws, string_split(text, chr(10)) as ls, text from d),
e as (select nr, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
g as (
  select nr, i, word, case when lead(word, 2) over p is not null then word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p end as gram
  from e window p as (partition by nr order by i)),
h as (select nr, i, word, gram is not null and count(*) over (partition by nr, gram) > 1 as hit from g),
c as (select nr, word, hit or coalesce(lag(hit) over p, false) or coalesce(lag(hit, 2) over p, false) as covered from h window p as (partition by nr order by i)),
k as (
  select nr, sum(length(word))::bigint as word_chars, count(*) filter (covered)::bigint as n_repeat_words,
    count(*) filter (lower(word) in ({_STOP}))::bigint as n_stop_words
  from c group by nr),
l as (
  select nr, count(*)::bigint as n_lines, count(distinct line)::bigint as n_distinct from (select nr, unnest(ls) as line from w)
  where regexp_matches(line, '{WORD}') group by nr),
m as (
  select d.doc_id, len(w.ws)::bigint as n_words, coalesce(k.word_chars, 0)::bigint as word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(l.n_lines - l.n_distinct, 0)::bigint as n_dup_lines,
    coalesce(k.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(k.n_stop_words, 0)::bigint as n_stop_words, coalesce(l.n_lines, 0) as n_lines
  from d join w using (nr) left join k using (nr) left join l using (nr)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  not base_failed and word_chars / n_words between 2.5 and 12.0 and n_symbols / n_words <= 0.2 and n_stop_words / n_words >= 0.05
    and n_dup_lines / n_lines <= 0.6 as kept
from f
""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.measured(docs).select("doc_id", "quality.*")



@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op5_substring_dedup", f"""
with d as (select doc_id, row_number() over () as nr, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
w as (
  select nr, i, array_to_string(ws[i:i + 34], ' ') as win
  from (select nr, ws, unnest(generate_series(1, len(ws) - 34)) as i from d where len(ws) >= 35)),
r as (select nr, i, count(*) over (partition by win) > 1 as hit from w),
g as (select distinct nr, unnest(generate_series(i, i + 34)) as i from r where hit),
e as (select nr, unnest(ws) as word, generate_subscripts(ws, 1) as i from d),
k as (select e.nr, string_agg(word, ' ' order by e.i) as kept, count(*) as n from e anti join g on e.nr = g.nr and e.i = g.i group by e.nr)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (nr)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.grouped(docs, ["doc_id"]).select(
        "row.doc_id", F.lower(F.lpad(F.hex("a"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


@query("op7_warc", """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
b as (
  select *, list_aggregate(list_transform(range(40), lambda i: list_extract(
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    instr('0123456789abcdef', substr(hex, i + 1, 1)))), 'string_agg', '') as bits
  from p),
f as (select hex, min(page_id) as first from p group by hex)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int
    + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int
    + substr(bits, 5 * i + 5, 1)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
from b join f using (hex)
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    records = warc.read(warc.write(pages), payloads=False)
    return records.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


@query("op8_license_scans")
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matches = F.col("licenses.matches")
    line = F.transform(matches, lambda m: F.format_string("%s:%d-%d:%.4f", m["template"], m["first_word"], m["last_word"], m["containment"]))
    return licenses.scanned(docs).select(
        "doc_id", "licenses.n_words", F.size(matches).cast("long").alias("n_matches"),
        F.array_join(F.array_distinct(F.transform(matches, lambda m: m["template"])), ",").alias("templates"), F.array_join(line, ";").alias("matches"),
    )


@query("op9_decontamination", r"""
with norm as (
  select 'd' as kind, doc_id::varchar as id, row_number() over () as nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 'b', item_id::varchar, row_number() over (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
bw as (
  select id, least(10, len(ws)) as size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as win
  from (select id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as i from norm where kind = 'b' and len(ws) > 0)),
sizes as (select distinct size from bw),
dw as (
  select nr, i, size, array_to_string(ws[i:i + size - 1], ' ') as win
  from (select nr, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as i from norm, sizes where kind = 'd' and len(ws) >= size)),
m as (select distinct dw.nr, dw.i, dw.size, bw.id from dw join bw using (size, win)),
hit as (select nr, count(*) as n from (select distinct nr, unnest(generate_series(i, i + size - 1)) as at from m) group by nr),
its as (select nr, count(distinct id)::bigint as n, array_to_string(list_sort(list(distinct id)), ',') as ids from m group by nr)
select nr2.doc_id, len(norm.ws)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items,
  sha256(coalesce(its.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from norm join (select doc_id, row_number() over () as nr from documents) nr2 using (nr) left join hit using (nr) left join its using (nr)
where kind = 'd'
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)
    return hits.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


@query("op10_url_filters", r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path, row_number() over () as nr
  from pages),
r (verdict, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (
  select u.nr, r.host || r.path as rule, r.verdict, row_number() over (partition by u.nr order by length(r.host || r.path) desc, length(r.host) desc) as k
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict from u left join m on m.nr = u.nr and k = 1
""")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, urls.RULE_SCHEMA)
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).withColumnRenamed("id", "page_id")


@query("op11_fim", r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as us,
    sha256('42:' || coalesce(doc_id::varchar, '')) as hex from documents),
h as (
  select doc_id, text, us, len(us)::bigint as n, ('0x' || substr(hex, 1, 8))::bigint as h1, ('0x' || substr(hex, 9, 8))::bigint as h2,
    ('0x' || substr(hex, 17, 8))::bigint as h3, ('0x' || substr(hex, 25, 8))::bigint as h4
  from d),
f as (
  select doc_id, text, us, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from h),
p as (
  select doc_id, text, n, form, array_to_string(us[1:a], '') as head, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:n], '') as tail
  from f)
select doc_id, n, form, case when form <> 'plain' then length(head) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid else '<S>' || tail || '<P>' || head || '<M>' || mid end)
    as output_sha256, sha256(text) as restored_sha256
from p
""")
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


@query("op12_dialogue_repair")
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    reports, turns = dialogue.repaired(dialogue.damaged(rows))
    ids, reports, texts = (x.withColumnRenamed(x.columns[0], c) for x, c in ((rows.select("conv_id").distinct(), "conv_id"), (reports, "r"), (dialogue.digests(turns), "t")))
    found = ids.join(reports, F.col("conv_id").eqNullSafe(F.col("r")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("t")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", held)
    model = langid.fitted(docs.filter(~F.col("held_out")))
    return langid.identified(docs, model).select("doc_id", "held_out", "language.lang_pred", "language.score", "language.cross_entropy", "language.rejected")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
