"""The registered queries of this package, each over its whole table, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from sojourn.llm.bpe import decode, encode
from sojourn.llm.divergence import source_divergence
from sojourn.llm.embeddings import near_vectors
from sojourn.llm.exact import exact_duplicates
from sojourn.llm.langid import fit, identify, remainder
from sojourn.llm.lm import score_texts
from sojourn.llm.mixing import mix_report
from sojourn.llm.pairtree import tree_decode, tree_encode
from sojourn.llm.pii import find_personal_data
from sojourn.llm.search import ranked_search
from sojourn.llm.simhash import near_duplicates
from sojourn.llm.store import documents
from sojourn.llm.tokenfile import read_token_files, token_folder, write_token_files
from sojourn.llm.urls import judge_urls, rule


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), words=4, radius=4)


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = find_personal_data(documents(spark, folder))
    return rows.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(rows.filter(~held_out))
    return identify(rows.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mix_report(documents(spark, folder))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size from documents),
per as (select source, sum(size)::BIGINT as source_size from sizes group by source),
weighted as (
  select *, source_size * 2 as cap,
         [3, 1, 2][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::INTEGER]::BIGINT as weight from per),
levels as (
  select *, (sum(source_size) over () * 1.5::DOUBLE
             - coalesce(sum(cap) over (order by cap / weight, source asc nulls last
                                       rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over ()
               - coalesce(sum(weight) over (order by cap / weight, source asc nulls last
                                            rows between unbounded preceding and 1 preceding), 0)) as step from weighted),
targets as (
  select source, source_size, least(cap::DOUBLE, weight * max(step) over ()) as target from levels),
rates as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate from targets),
drawn as (
  select doc_id, size, source_size, target, rate,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE as draw
  from sizes join rates on sizes.source is not distinct from rates.source)
select doc_id, size, source_size, target,
       (size * (floor(rate) + (draw < rate - floor(rate))::INTEGER))::BIGINT as taken
from drawn
"""


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return score_texts(documents(spark, folder), remainder(F.col("doc_id"), 10) == 0, path, end_id=49407, vocabulary=49408)


def op8_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


OP8_SQL = """
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from texts window same as (partition by text)
"""

def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(documents(spark, folder), token_folder(spark), path, end_id=1, vocabulary=49408)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


URL_RULES = (
    rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/"),
)


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES)


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(documents(spark, folder).select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    return decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(documents(spark, folder))


OP11_SQL = r"""
with words as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
tokens as (select doc, lang, source, unnest(terms) as term from words),
per_source as (select lang, source, term, count(*) as n from tokens group by all),
kept as (select lang, term, count(*) as in_lang from tokens group by all having count(distinct doc) >= 30),
langs as (select w.lang, (select count(*) from kept k where k.lang = w.lang) as v,
                 coalesce((select sum(in_lang) from kept k where k.lang = w.lang), 0) as all_words
          from (select distinct lang from words) w),
groups as (
  select g.lang, g.source, l.v, l.all_words, coalesce(s.n, 0) as words
  from (select distinct lang, source from words) g join langs l using (lang)
  left join (select lang, source, sum(p.n) as n from per_source p join kept using (lang, term) group by all) s using (lang, source)),
shares as (
  select g.lang, g.source, k.term, coalesce(p.n, 0) as n,
         1 + (1000000000::HUGEINT * (coalesce(p.n, 0) + 5)) // (g.words + 5 * g.v)::HUGEINT as p,
         1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (g.all_words + 5 * g.v)::HUGEINT as q
  from groups g join kept k using (lang) left join per_source p using (lang, source, term)),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::BIGINT as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value
             from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
    on f.lang = a.lang and f.source = a.source and f.other = b.source),
ranked as (
  select *, row_number() over (partition by lang, source order by value desc, item)::INTEGER as rank from pairs
  union all
  select * from (
    select lang, source, 'term', term, (p - q)::BIGINT, row_number() over (partition by lang, source order by p - q desc, term)::INTEGER as rank
    from shares where n > 0 and p > q) where rank <= 50)
select lang, source, part, item, value, rank from ranked
"""


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP12_SQL = r"""
with texts as (
  select row_number() over () as doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
docs as (select doc, doc_id, terms, len(terms)::BIGINT as n from texts where len(terms) > 0),
corpus as (select count(*)::BIGINT as docs, sum(n)::BIGINT as length from docs),
items as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*)::BIGINT as times from items group by all),
tokens as (select doc, unnest(terms) as term from docs),
postings as (select doc, term, count(*)::BIGINT as tf from tokens where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT as w
  from (select term, count(*)::BIGINT as df from postings group by term), corpus),
impacts as (
  select p.doc, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) as impact
  from postings p join weights using (term) join docs using (doc), corpus),
scores as (
  select item_id, doc, sum(times * impact)::BIGINT as score from asked join impacts using (term) group by all)
select item_id, rank, doc_id, score from (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::INTEGER as rank, doc_id, score
  from scores join docs using (doc) where score > 0)
where rank <= 10
"""


def op13_pair_tree(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = tree_encode(documents(spark, folder).select("doc_id", "text"), path, binary=True).drop("text")
    return tree_decode(ids, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_embeddings, op4_language, op5_mixing, op6_token_files, op7_language_model, op8_exact, op9_urls, op10_byte_bpe, op11_divergence, op12_search, op13_pair_tree)}
SQL = {"op5_mixing": OP5_SQL, "op8_exact": OP8_SQL, "op11_divergence": OP11_SQL, "op12_search": OP12_SQL}
