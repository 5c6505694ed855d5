"""The queries of this folder: name -> function of (session, folder of tables), and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .conversation_trie import conversation_trie
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .line_dedup import line_dedup
from .lm_scoring import cross_entropy_difference
from .mixing import mix
from .near_dedup import near_classes
from .periodic_runs import periodic_runs, run_digests, with_planted_run
from .quality import quality_scores
from .sentencepiece_bpe import encode_documents
from .telephony import telephony
from .url_filters import HOST_RULES, PATTERNS, op7
from .warc import warc_round_trip


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the resampled PCM itself."""
    return telephony(table(spark, sf_dir, "documents"), with_pcm=True)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus: documents labelled good."""
    target = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), openings=True)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), prepare=with_planted_run))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_telephony_audio": op1,
    "op2_exact_dedup": op2,
    "op3_line_dedup": op3,
    "op4_html_text": op4,
    "op5_lm_scoring": op5,
    "op6_quality_classifier": op6,
    "op7_url_filters": op7,
    "op8_sentencepiece": op8,
    "op9_mix_sources": op9,
    "op10_near_dedup": op10,
    "op11_conversation_trie": op11,
    "op12_periodic_runs": op12,
    "op13_warc": op13,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
        from d join g using (t)""",
    "op3_line_dedup": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from d),
        k as (select doc_id, pos, line, translate(trim(line, {STRIP}), '{UPPER}', '{LOWER}') as key from l),
        f as (select key, min(doc_id) as lead from k where length(key) >= 10 group by key),
        r as (select k.doc_id, k.pos, k.line, f.lead is not null and f.lead < k.doc_id as gone from k left join f using (key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from r group by doc_id""",
    "op7_url_filters": f"""
        with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        r(h, pre, v) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)}),
        b as (select page_id, arg_max(h || pre, length(h || pre)) as rule, arg_max(v, length(h || pre)) as v
          from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by page_id)
        select p.page_id, p.host, p.path, b.rule, coalesce(b.v, case when regexp_matches(lower(host || path),
          '(^|[^a-z0-9])({"|".join(x.strip("^") for x, v in PATTERNS if v == "block")})([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
        from p left join b using (page_id)""",
    # CRC-32 by its table; each node's totals are sums over the rest of its members' paths
    "op11_conversation_trie": """
        with step as (select list_transform(range(256), lambda n: list_reduce(list_concat([n::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos,
          coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        convs as (select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
          lambda c, b: xor(c >> 8, any_step[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h
          from (select distinct conv_id from conversations where conv_id is not null), (select t as any_step from step)),
        path as (select c.conv_id, b.pos, b.role, b.text from convs c join turns b on b.conv_id = c.base and b.pos <= c.h
          union all select c.conv_id, t.pos - c.h + least(c.h, coalesce(o.n, 0)), t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
            left join (select conv_id, count(*) as n from turns group by conv_id) o on o.conv_id = c.base),
        named as (select conv_id, pos, length(text) as chars, list(struct_pack(role, text)) over (partition by conv_id order by pos rows unbounded preceding) as prefix from path
          union all select conv_id, 0, 0, [] from convs),
        owned as (select *, md5(prefix::varchar) as name, min(conv_id) over (partition by prefix) as owner, count(*) over (partition by prefix) as n,
          max(pos) over (partition by conv_id) as last from named),
        leafs as (select *, max(last) over (partition by prefix) = pos as leaf, lag(owner) over (partition by conv_id order by pos) as parent from owned),
        sums as (select *, sum(case when owner = conv_id and leaf then 1 else 0 end) over after as leaves, sum(case when owner = conv_id then (n - 1) * chars else 0 end) over after as saved,
          lead(case when owner = conv_id then 1 else 0 end) over (partition by conv_id order by pos) as kid
          from leafs window after as (partition by conv_id order by pos rows between current row and unbounded following))
        select any_value(owner) as conv_id, any_value(pos)::bigint as depth, any_value(parent) as parent_conv_id, count(*) as n_convs, coalesce(sum(kid), 0)::bigint as n_children, sum(leaves)::bigint as n_leaves,
          sum(saved)::bigint as saved_tokens, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (pos = last), '')) as ends_sha256
        from sums group by prefix""",
    "op13_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        q as (select page_id, html, octet_length(encode(html)) as n, max(page_id) over (partition by html) as lead from p)
        select page_id, n as payload_bytes, sha1(html) as payload_digest, case when n >= 1000 and page_id <> lead then 'revisit' else 'response' end as record_type,
          case when n >= 1000 and page_id <> lead then lead end as refers_to, null::varchar as error, true as verified from q""",
}
