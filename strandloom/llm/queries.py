"""Queries of the training-data operators: thin, they only derive the asked columns from what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import remove_shared

    out = remove_shared(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: Verdict, host and path of each rule.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "bad")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    # a score without a model is below the threshold
    return out.select("doc_id", "held_out", "score", F.coalesce("predicted", F.lit(0)).alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_amounts

    out = mixed_amounts(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import SIGNALS, judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", *SIGNALS, "base_failed", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    out = archived(table(spark, sf_dir, "pages"), with_payload=False, least=0)
    number = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("long")
    return out.select(
        number("metadata.fields", r"pageId: (-?[0-9]+)").alias("page_id"),
        F.coalesce("main.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        number("main.refers_to", r":capture:(-?[0-9]+):").alias("refers_to"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import rearranged, restored

    out = rearranged(table(spark, sf_dir, "documents").select("doc_id", "text"), units="lines", seed=7, rate=100, spm=50)
    digest = lambda x: F.sha2(F.encode(x, "utf-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"), family=20, heads=4)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_url_filter, op4_embedding_near_dedup, op5_quality_classifier, op6_source_mixing, op7_quality_rules, op8_suffix_dedup, op9_byte_bpe, op10_warc, op11_fill_middle, op12_hash_forest, op13_prefix_trie)}

#: DuckDB SQL of the queries whose whole result the contract fixes.
WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
ORACLE: dict[str, str] = {
    "op1_substring_dedup": f"""with d as (select doc_id, {WORDS.format("text")} w from documents),
        s as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) k from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d)),
        f as (select doc_id, i, min(doc_id) over (partition by k) < doc_id hit from s),
        x as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) word from d),
        c as (select doc_id, i, word, coalesce(max(case when hit then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row), 0) gone from x left join f using (doc_id, i))
        select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(r, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
        from d left join (select doc_id, sum(gone) r, string_agg(word, ' ' order by i) filter (gone = 0) kept from c group by doc_id) using (doc_id)""",
    "op2_minhash_near_dedup": f"""with recursive d as (select doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
        g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) s from d),
        n as (select doc_id, len(s) n from g), x as (select doc_id, unnest(s) k from g),
        p as (select a.doc_id a, b.doc_id b, count(*) c from x a join x b using (k) where a.doc_id < b.doc_id group by 1, 2),
        e as (select a, b from p join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 80 * (u.n + v.n - c)),
        h as (select a, b from e union select b, a from e), r as (select a id, a r from h union select r.id, h.b from r join h on h.a = r.r), m as (select id, min(r) m from r group by id)
        select doc_id, cast(n as bigint) n_shingles, coalesce(m, doc_id) component_id, coalesce(m, doc_id) = doc_id kept from n left join m on id = doc_id""",
    # at full recall, which the query tells
    "op4_embedding_near_dedup": """with recursive v as (select vec_id, cast(embedding as double[]) x from embeddings), n as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) l from v where x is not null and list_bool_and(list_transform(x, lambda y: y is not null and isfinite(y))) and list_sum(list_transform(x, lambda y: y * y)) > 0),
        e as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_dot_product(a.x, b.x) >= 0.9 * a.l * b.l),
        r as (select a id, b r from e union select r.id, e.b from r join e on e.a = r.r), m as (select id, min(r) m from r group by id), c as (select a, count(*) n from e group by a)
        select vec_id, coalesce(c.n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept, case when exists (select 1 from e) then cast(1 as double) end recall from embeddings left join c on a = vec_id left join m on id = vec_id""",
    "op8_suffix_dedup": """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
        b as (select doc_id, h, unnest(range(0, length(h) // 2)) i from d),
        s as (select doc_id, i, substr(h, 2 * i + 1, 2) x, case when 2 * i + 400 <= length(h) then md5(substr(h, 2 * i + 1, 400)) end k from b),
        f as (select doc_id, i, x, case when k is not null and count(*) over (partition by k) > 1 then 1 else 0 end hit from s),
        c as (select doc_id, i, x, max(hit) over (partition by doc_id order by i rows between 199 preceding and current row) gone from f),
        t as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 head from c)
        select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(r, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
        from d left join (select doc_id, sum(gone) r, count(*) filter (head) spans, string_agg(x, '' order by i) filter (gone = 0) kept from t group by doc_id) using (doc_id)""",
    "op10_warc": """with p as (select page_id, coalesce(html, '') b from pages), s as (select page_id, cast(strlen(b) as bigint) n, sha1(b) h, max(page_id) over (partition by b) m from p),
        t as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31 as int) + 1, 1)), '') digest from s)
        select page_id, n payload_bytes, digest payload_digest, case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to from t""",
    "op11_fill_middle": r"""with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) x from documents),
        u as (select *, coalesce(regexp_extract_all(t, '[^\n]*\n|[^\n]+'), []) l, list_transform([0, 1, 2, 3], lambda i: cast('0x' || substr(x, cast(8 * i + 1 as int), 8) as bigint)) h from d),
        c as (select *, len(l) n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end form from u),
        p as (select *, array_to_string(list_slice(l, 1, a), '') pre, array_to_string(list_slice(l, a + 1, b), '') mid, array_to_string(list_slice(l, b + 1, n), '') suf from c)
        select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(pre) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256 from p""",
    # at full recall, which the query tells
    "op12_hash_forest": """with v as (select vec_id, cast(embedding as double[]) x from embeddings), n as (select * from v where vec_id is not null and len(x) > 0 and list_bool_and(list_transform(x, lambda y: y is not null and isfinite(y))) and list_bool_or(list_transform(x, lambda y: y <> 0))),
        p as (select a.vec_id query_id, b.vec_id, list_dot_product(a.x, b.x) score from n a join n b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 20 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) "rank", vec_id, score, cast(1 as double) recall from p qualify "rank" <= 20""",
    # crc32 bit by bit; only its last two bits are asked for
    "op13_prefix_trie": f"""with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
        b as (select distinct c, list_transform(range(1, length(cast(c as varchar)) + 1), lambda i: [ascii(substr(cast(c as varchar), cast(i as int), 1)), -1, -1, -1, -1, -1, -1, -1, -1]) l from t),
        h as (select c, c - c % 20 base, xor(list_reduce(list_prepend(4294967295, list_transform(flatten(l), lambda v: cast(v as bigint))), lambda a, v: case when v >= 0 then xor(a, v) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 4 h from b),
        own as (select c, pos, r, x, md5(r) || md5(x) s, cast(len({WORDS.format("x")}) as bigint) w from t),
        k as (select h.c, h.h, count(own.pos) k from h left join own on own.c = h.base and own.pos <= h.h group by 1, 2),
        u as (select h.c, own.pos depth, s, w from h join own on own.c = h.base and own.pos <= h.h union all select k.c, k.k + own.pos - k.h, s, w from k join own on own.c = k.c and own.pos > k.h),
        p as (select c, depth, w, md5(string_agg(s, ' ') over (partition by c order by depth)) key from u),
        e as (select c, 0 depth, 0 w, '' key from h union all select c, depth, w, key from p),
        m as (select *, coalesce(lag(key) over (partition by c order by depth), '') up, depth = max(depth) over (partition by c) last from e),
        n as (select depth, key, min(up) up, min(c) conv_id, count(*) n_convs, min(w) w, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '') ends from m group by 1, 2),
        ch as (select depth - 1 depth, up key, count(*) n_children from n where depth > 0 group by 1, 2),
        v as (select n.*, coalesce(n_children, 0) n_children from n left join ch using (depth, key)),
        s as (select m.depth, m.key, sum((v.n_convs - 1) * v.w) saved, count(*) filter (v.n_children = 0) leaves from v join m on m.c = v.conv_id and m.depth <= v.depth group by 1, 2)
        select v.conv_id, cast(v.depth as bigint) depth, q.conv_id parent_conv_id, v.n_convs, v.n_children, s.leaves n_leaves, cast(s.saved as bigint) saved_tokens, sha256(v.ends) ends_sha256
        from v join s using (depth, key) left join v q on q.depth = v.depth - 1 and q.key = v.up""",
}
