"""The thin opN_ queries; every one reads its whole table through its operator."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lm, media, packing, quality, resample, secrets, simhash, suffix, toxicity, trie
from ._common import documents, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.report(docs, secrets.train(docs))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(documents(spark, sf_dir))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    # not store(): written streams take 1.8 times the input's bytes on disk
    return media.report(media.encoded(documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(documents(spark, sf_dir))


QUERIES = {"op1_quality": op1_quality, "op2_secrets": op2_secrets, "op3_langid": op3_langid, "op4_ann": op4_ann, "op5_bpe": op5_bpe, "op6_simhash": op6_simhash,
           "op7_suffix": op7_suffix, "op8_flac": op8_flac,
           "op9_toxicity": op9_toxicity, "op10_packing": op10_packing, "op11_resample": op11_resample, "op12_trie": op12_trie, "op13_lm": op13_lm}

#: CRC-32 by its table of 256 steps, over the bytes of each distinct feature.
OP11_SQL = r"""
with step as (
    select list(c order by i) as t from (
        select i, list_reduce(list_concat([i], range(8)), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))),
texts as (
    select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as (
    select side, id, unnest(w) as word, generate_subscripts(w, 1) as pos
    from (select side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts)),
runs as (
    select side, id, word, lead(word) over along as w2, lead(word, 2) over along as w3 from words window along as (partition by side, id order by pos)),
features as (
    select side, id, word as f, 1 as one from runs union all select side, id, word || ' ' || w2, 0 from runs where w2 is not null
    union all select side, id, word || ' ' || w2 || ' ' || w3, 0 from runs where w3 is not null),
hashed as (
    select f, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)),
                                          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 10000 as bucket
    from (select distinct f from features), step),
placed as (select side, id, bucket, one from features join hashed using (f)),
sums as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from placed group by bucket),
gains as (
    select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from sums),
weights as (
    select id as doc_id, count(*) as n_features, sum(one) as n_words, sum(gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by id),
scored as (
    select doc_id, coalesce(n_features, 0) as n_features, coalesce(n_words, 0) >= 20 as enough, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from documents left join weights using (doc_id)),
ordered as (
    select *, row_number() over (partition by enough order by score desc, doc_id) as r, count(*) filter (enough) over () as n from scored)
select doc_id, n_features, weight, score, case when enough and r <= 5 * n // 100 then r end as rank from ordered
"""
#: Paths are lists of turns; a subtree is what its members' longer paths are.
OP12_SQL = r"""
with step as (
    select list(c order by i) as t from (
        select i, list_reduce(list_concat([i], range(8)), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))),
own as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as turn
    from conversations where conv_id is not null),
ids as (
    select c, c - c % 5 as b, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(c::varchar)), lambda i: ascii(substr(c::varchar, i + 1, 1))::bigint)),
                                                          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 as h
    from (select distinct c from own), step),
mixed as (
    select ids.c, 0 as part, pos, turn from ids join own on own.c = ids.b where pos <= h
    union all select ids.c, 1, pos, turn from ids join own on own.c = ids.c where pos > h),
turns as (select c, row_number() over (partition by c order by part, pos) as d, turn from mixed),
paths as (
    select c, 0 as d, '' as path, '' as up, 0 as bytes from ids
    union all select c, d, list(turn) over w::varchar, case when d = 1 then '' else list(turn) over v::varchar end, strlen(turn.text)
    from turns window w as (partition by c order by d), v as (partition by c order by d rows between unbounded preceding and 1 preceding)),
lengths as (select ids.c, count(d) as n from ids left join turns using (c) group by ids.c),
found as (
    select path, d, min(up) as up, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes,
           sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256
    from paths join lengths using (c) group by path, d),
numbered as (select *, row_number() over () as id, (select count(*) from found x where x.d = found.d + 1 and x.up = found.path) as n_children from found),
placed as (select c, numbered.* from paths join numbered using (path, d)),
below as (
    select distinct a.id, b.id as under, b.n_children, (b.n_convs - 1) * b.bytes as saved from placed a join placed b on a.c = b.c and b.d >= a.d),
sums as (select id, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from below group by id)
select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from numbered v join sums using (id) left join found p on v.d = p.d + 1 and v.up = p.path
"""
ORACLE_SQL: dict[str, str] = {"op12_trie": OP12_SQL, "op11_resample": OP11_SQL}
