"""The queries of this subpackage by name, and the SQL of those that SQL can express: those whose contract leaves no choice of model, sketch or hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import fingerprint, langid, licenses, maxent, minhash, mixing, passages, periods, pieces, resampling, secrets, targeting, vectors

#: Classes by links l (a, b, both ways) among ids: the least id that each reaches.
_CLASSES = "r as (select id, id as o from ids union select l.b, r.o from r join l on r.id = l.a where r.o < l.b), c as (select id, min(o) as component_id from r group by id)"

_VECTORS = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
 s as (select * from v where vec_id is not null and label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
 l as (select a.vec_id as a, b.vec_id as b from s a join s b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93e0),
 ids as (select vec_id as id from v), n as (select a, count(*) as n from l group by a), {_CLASSES}
 select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from v join c on v.vec_id = c.id left join n on v.vec_id = n.a"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
 s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as s from w),
 e as (select doc_id, unnest(s) as g from s), i as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from i join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
 ids as (select doc_id as id from documents), {_CLASSES}
 select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c on s.doc_id = c.id"""

#: crc32 word by word, by its table of 256 steps; the words of all texts are told apart first.
_TARGET = r"""with recursive t(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t where k < 8),
 steps as (select list(c order by i) as steps from t where k = 8),
 w as (select 0 as side, doc_id, unnest(W) as w from documents union all select 1, null, unnest(W) from benchmark),
 own as (select w, hex(encode(w)) as h from (select distinct w from w)),
 hashed as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket from own, steps),
 n as (select bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t from w join hashed using (w) group by bucket),
 total as (select cast(sum(s) as double) as s, cast(sum(t) as double) as t from n),
 gain as (select bucket, cast(floor(1000 * ln((n.t + 1e0) * (total.s + 10000) / ((n.s + 1e0) * (total.t + 10000)))) as bigint) as gain from n, total),
 per as (select doc_id, count(*) as n, cast(sum(gain) as bigint) as weight from w join hashed using (w) join gain using (bucket) where side = 0 group by doc_id),
 d as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5e0) / 4294967296e0))) as bigint) as score from documents left join per using (doc_id)),
 r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from d where n_features >= 20)
 select d.*, case when place <= 10 * total // 100 then place end as rank from d left join r using (doc_id)""".replace("W)", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (maxent.op1_lm_scoring, pieces.op2_pieces, mixing.op3_mixing, resampling.op4_importance_resampling, fingerprint.op5_fingerprints, langid.op6_language_id, secrets.op7_secret_scan, vectors.op8_embedding_near_dedup, passages.op9_repeated_passages, minhash.op10_minhash_near_dedup, periods.op11_periodic_runs, licenses.op12_license_scan, targeting.op13_target_resampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_near_dedup": _VECTORS, "op10_minhash_near_dedup": _SHINGLES, "op13_target_resampling": _TARGET}
