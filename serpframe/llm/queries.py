"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.llm import (decontaminate, importance, language_id, lattice, licenses, mixing, near_dups, phrases, pii,
                           quality, relative_parse, token_counts, toxicity)
from serpframe.llm.tables import read_table
from serpframe.session import scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, then exact copies of a smaller doc_id deleted, the second batch committed twice."""
    docs = read_table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token-rollup"), token_counts.Tokenizer())
    rollup.commit(1, docs.withColumn("kind", F.lit("insert")))
    keyed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = keyed.join(first, "sha").where("doc_id > first").withColumn("kind", F.lit("delete")) \
        .withColumn("text", F.lit(None).cast("string"))
    for _ in range(2):
        rollup.commit(2, copies)
    return rollup.totals()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)
    return out.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, keep=("doc_id",))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return out.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                      "accepted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relative_parse.remove_repeats(read_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85, bands=24, rows=5)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"), least=100, longest=5, percent=100, top=2000)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)
    return out.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lattice": op4_lattice,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_phrases": op12_phrases,
    "op13_quality": op13_quality,
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op11_importance": rf"""
with recursive step(i, b, x) as (
  select 0, r::bigint, r::bigint from range(256) t(r)
  union all select i + 1, b, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end) from step where i < 8),
tab as materialized (select list(x order by b) t from step where i = 8),
w as (select 0 kind, doc_id, row_number() over () rid, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from documents
      union all select 1, item_id, row_number() over (), regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
      from benchmark),
f as materialized (
  select kind, rid, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) feature from w),
crc(feature, hx, pos, acc) as (
  select feature, hex(encode(feature)), 0, 4294967295::bigint from (select distinct feature from f)
  union all
  select feature, hx, pos + 1,
         xor(acc >> 8, t[(xor(acc, ('0x' || substr(hx, 2 * pos + 1, 2))::bigint) & 255) + 1])
  from crc, tab where 2 * pos < len(hx)),
bucket as materialized (
  select feature, xor(acc, 4294967295) % 10000 b from crc where 2 * pos = len(hx)),
n as (select kind, b, count(*)::double c from f join bucket using (feature) group by all),
total as (select coalesce(sum(c) filter (kind = 0), 0) s, coalesce(sum(c) filter (kind = 1), 0) t from n),
gain as materialized (
  select x.b, floor(1000 * ln((coalesce(q.c, 0) + 1) * (s + 10000) / ((coalesce(p.c, 0) + 1) * (t + 10000))))::bigint g
  from (select distinct b from n) x left join n p on p.b = x.b and p.kind = 0 left join n q on q.b = x.b and q.kind = 1, total),
d as (select rid, count(*)::bigint n_features, floor(sum(g)::double / count(*))::bigint weight
      from f join bucket using (feature) join gain using (b) where kind = 0 group by rid),
h as (select rid, doc_id, len(w) n_words,
             (('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296 u
      from w where kind = 0),
z as (select h.rid, doc_id, n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln(u))))::bigint score from h left join d using (rid)),
k as (select rid, row_number() over (order by score desc, doc_id) r, count(*) over () many from z where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= 25 * many // 100 then r end rank from z left join k using (rid)""",
    "op12_phrases": rf"""
with p as (
  select coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')),
         '[^\x20\x09]+') w from documents),
n as (select lang, sum(len(w)) n from p group by lang),
f as materialized (
  select lang, k, array_to_string(g, ' ') phrase, count(*)::hugeint c
  from (select lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) g from p, range(1, 6) t(k)) group by all
  having count(*) >= 100),
cand as (select lang, k, phrase, c a, string_split(phrase, ' ') w from f where k > 1),
cut as (select lang, phrase, a, j, array_to_string(w[:j], ' ') x, array_to_string(w[j + 1:], ' ') y
        from cand, range(1, 5) t(j) where j < k),
best as (select cut.lang, cut.phrase, a, j, x.c l, y.c r, n, (1000 * a * n::hugeint) // (x.c * y.c) score
         from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y
         join n on n.lang = cut.lang
         qualify row_number() over (partition by cut.lang, cut.phrase order by score, j) = 1),
inside as (select distinct lang, array_to_string(w[i:i + m - 1], ' ') phrase, a
           from cand, range(2, 5) t(m), range(1, 5) u(i) where m < k and i + m - 1 <= k),
kept as (select * from best where not exists
         (select 1 from inside where inside.lang = best.lang and inside.phrase = best.phrase and 100 * inside.a >= 100 * best.a))
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank, phrase, a::bigint a,
       l::bigint l, r::bigint r, n::bigint n, score::bigint score
from kept qualify rank <= 2000""",
    "op6_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 u
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end weight,
             2 * source_size cap, sum(source_size) over () * 1.5::double total from s),
l as (select *, (total - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (o rows between current row and unbounded following) lev
      from w window o as (order by cap / weight, source nulls last)),
a as (select *, first_value(case when lev * weight <= cap then lev end ignore nulls)
                over (order by cap / weight, source nulls last rows between unbounded preceding and current row) lvl from l),
t as (select source, source_size, case when lvl is null then cap::double else least(cap::double, lvl * weight) end target from a),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end rate
      from d join t on d.source is not distinct from t.source),
f as (select *, floor(rate) whole, rate - floor(rate) p, target - floor(rate) * source_size need from r),
k as (select *, case when p > 0 then u / (1 - u) / (p / (1 - p)) end rank from f),
c as (select *, sum(size) over (partition by source order by rank) upto from k),
n as (select source, max(case when upto < need then rank end) low, max(case when upto < need then upto end) low_to,
             min(case when upto >= need then rank end) high, min(case when upto >= need then upto end) high_to
      from c where p > 0 group by source)
select doc_id, size, source_size, target,
       ((whole + case when p <= 0 then 0
                      when rank <= case when high_to - need < need - coalesce(low_to, 0) then high else coalesce(low, -1.0) end
                      then 1 else 0 end) * size)::bigint taken
from c left join n on c.source is not distinct from n.source""",
    "op3_substring_dedup": rf"""
with d as (select doc_id, {_WORDS.format('text')} w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) i, w from d where len(w) >= 50),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from p),
low as (select h, min(doc_id) m from win group by h),
hit as (select doc_id, i from win join low using (h) where m < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) k from hit),
rest as (select doc_id, list(k) ks from gone group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(ks), 0)::bigint n_removed,
       sha256(case when ks is null then array_to_string(w, ' ')
              else array_to_string([w[k] for k in range(1, len(w) + 1) if not list_contains(ks, k)], ' ') end) kept_sha256
from d left join rest using (doc_id)""",
    "op9_minhash": rf"""
with recursive d as (
  select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w
  from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
inter as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
          group by 1, 2),
l as (select x, y from inter join n p on p.doc_id = x join n q on q.doc_id = y
      where 100 * c >= 85 * (p.n + q.n - c)),
e as (select x, y from l union select y, x from l),
reach as (select doc_id, doc_id r from d union select reach.doc_id, e.y from reach join e on e.x = reach.r),
c as (select doc_id, min(r) component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept
from d left join n using (doc_id) join c on c.doc_id = d.doc_id""",
}
