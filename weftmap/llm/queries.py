"""The registered query of each operator, with production parameters, and SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, langid, license_scan, media, packing, simhash, token_counts, url_filter
from .common import table

BLOCK_RULES = [("net", "/"), ("example.com", "/de/")]
ALLOW_RULES = [("example.net", "/en/"), ("org", "/fr/")]
#: Words of host names that are blocked where no rule fits.
BLOCK_LABELS = ("ads", "adserver", "bets", "casino", "porn", "track", "tracker", "xxx")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), separator=49407)
    return counts.select("doc_id", "n_tokens")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.encode_media(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), BLOCK_RULES, ALLOW_RULES, BLOCK_LABELS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    chats = chat.format_chats(turns.unionByName(extra))
    sized = chats.withColumn("formatted_chars", F.char_length("formatted").cast("long"))
    parsed = chat.read_turns(sized, "formatted_chars").withColumn("loss", F.array_join("loss_texts", ""))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_packing, op3_language_id, op4_token_counts, op5_exact_dedup, op6_media, op7_url_filter, op8_simhash, op9_bpe, op10_chat)
}



def _license_sql(stride: int = 32, threshold: float = 0.8) -> str:
    """The scan by comparing every block with every template."""
    rows = []
    for names, whole in ((license_scan.PHRASES, True), (license_scan.NOTICES, False)):
        for t in license_scan.order_templates(names, {}, threshold, whole):
            words = ", ".join(f"'{w}'" for w in t.words)
            rows.append(f"('{t.label}', {str(whole).lower()}, [{words}], {t.need})")
    starts = []
    for phrase in license_scan.PHRASES:
        same = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        starts.append(f"list_filter(range(len(w)), lambda i: {same})")
    base = " || ".join(f"case when len(p{k}) > 0 then ['{label}'] else [] end" for k, label in enumerate(license_scan.PHRASES.values()))
    places = ", ".join(f"p{k}" for k in range(len(starts)))
    return rf"""
        with t(label, is_phrase, words, need) as (values {", ".join(rows)}),
        d as (
            select doc_id, row_number() over () as rid,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents),
        b as (select rid, w, unnest(range((len(w) + {stride - 1}) // {stride})) as k from d),
        c as (select rid, list_distinct(w[k * {stride} + 1 : k * {stride} + {2 * stride}]) as s from b),
        m as (select rid, label, is_phrase, len(list_intersect(s, words)) / len(words) as containment from c join t on len(list_intersect(s, words)) >= need),
        g as (select rid, coalesce(list(distinct label) filter (where not is_phrase), []) as own, max(containment) as score from m group by rid),
        f as (select doc_id, rid, len(w) as n_words, {", ".join(f"{x} as p{k}" for k, x in enumerate(starts))} from d),
        h as (select doc_id, rid, n_words, flatten([{places}]) as starts, {base} as base from f)
        select doc_id, n_words, cast(len(starts) as bigint) as n_base, list_min(starts) as first_word, list_max(starts) as last_word,
               coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') as base_labels,
               coalesce(array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ','), '') as labels,
               coalesce(score, 0.0) as score
        from h left join g on h.rid = g.rid
    """


_LABEL_LIST = ", ".join(f"'{w}'" for w in BLOCK_LABELS)

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op5_exact_dedup": r"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
        r as (
            select *, count(*) over (partition by norm) as group_size,
                   first_value(doc_id) over w as keep_id, row_number() over w as place
            from d window w as (partition by norm order by length(t) desc, doc_id))
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from r
    """,
    "op7_url_filter": f"""
        with p as (
            select page_id,
                   case when url like '%://%' then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
                   case when url like '%://%' then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
            from pages),
        rules(h, q, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fit as (
            select page_id, p.host, p.path, arg_max(h || q, length(h || q)) as rule, arg_max(verdict, length(h || q)) as verdict
            from p join rules on (p.host = h or p.host like '%.' || h) and starts_with(p.path, q) group by all)
        select p.page_id, p.host, p.path, fit.rule,
               case when fit.rule is not null then fit.verdict
                    when len(list_intersect(regexp_split_to_array(p.host, '[.\\-]'), [{_LABEL_LIST}])) > 0 then 'block' else 'allow' end as verdict
        from p left join (select distinct page_id, host, path, rule, verdict from fit) fit on p.page_id = fit.page_id and p.host = fit.host and p.path = fit.path
    """,
    "op10_chat": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (
            select *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) as n_text,
                   length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) as n_role,
                   lag(role) over (partition by conv_id order by turn, role, text) as before
            from t)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
               cast(sum(n_text + case when before is not distinct from role and before is not null then 8 else n_role + 8 + 1 + 8 end) as bigint) as formatted_chars
        from e group by conv_id
    """,
}
