"""Text expressions over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import corpus as K
from sparkloom.operators import history as H
from sparkloom.operators import sid as S
from sparkloom.plans.common import EVENTS, SID, SPACE, events, sids
from sparkloom.plans.registry import table


def clean_sql(c: str, n: int) -> str:
    """clean_text as a SQL expression."""
    flat = f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '{SPACE}', ' ', 'g'))"
    words = f"string_split({flat}, ' ')"
    low = f"string_split(lower({flat}), ' ')"
    uniq = f"array_to_string([w FOR w, i IN {words} IF list_position({low}, lower(w)) = i], ' ')"
    return f"CASE WHEN length({uniq}) > {n} THEN regexp_replace(substr({uniq}, 1, {n}), '{SPACE}$', '') ELSE {uniq} END"


def clean_text(spark, folder):
    """Titles at 200 and descriptions at 500 characters."""
    return table(spark, folder, "catalog").select("item_id", X.clean_text(F.col("title"), 200).alias("title"), X.clean_text(F.col("description"), 500).alias("description"))


def strip_markup(spark, folder):
    """P6, P7 alone."""
    return table(spark, folder, "catalog").select("item_id", X.collapse_space(X.strip_tags(F.coalesce("title", F.lit("")))).alias("title"))


def clean_documents(spark, folder):
    """P10 over whole documents of any length."""
    return table(spark, folder, "documents").select("doc_id", X.clean_text(F.col("text"), 1 << 30).alias("text"))


def metadata_prompts(spark, folder):
    """P11."""
    prompt = X.metadata_prompt(F.col("title"), F.col("sub_category"), F.col("description"))
    return table(spark, folder, "catalog").select("item_id", prompt.alias("input_text"))


def sid_strings(spark, folder):
    """Codes to text and back, and padded prefixes."""
    codes = [F.col(f"sid_{i}") for i in range(4)]
    rows = sids(spark, folder).select("item_id", X.sid_target(codes).alias("target_text"))
    parsed = X.parse_sids(F.col("target_text"))
    return rows.select("item_id", "target_text", parsed.alias("sid"), X.pad_sids(F.slice(parsed, 1, 2)).alias("padded"))


def shard_paths(spark, folder):
    """P16."""
    return table(spark, folder, "catalog").select("item_id", X.shard_path("images", F.col("item_id")).alias("path"))


def first_elements(spark, folder):
    """The first category with an ampersand, and the second entry or ''."""
    c = F.col("categories")
    return table(spark, folder, "catalog").select("item_id", X.first_match(c, lambda x: x.contains("&")).alias("with_and"), X.element_or(c, 1, "").alias("second"))


def prompt_periods(spark, folder):
    """P20."""
    return table(spark, folder, "catalog").select("item_id", X.end_with_period(F.coalesce("description", F.lit(""))).alias("prompt"))


#: The first added token, the padding and end tokens behind the codes' tokens, and the lengths that training cuts at.
FIRST_TOKEN, PAD_TOKEN, EOS_TOKEN, MAX_INPUT, MAX_TARGET = 32_100, 33_124, 33_125, 512, 16


def label_masks(spark, folder):
    """Inputs of all codes of a user's last 150 items, cut and padded, and labels of the last item's codes with masked padding."""
    chained = H.chains(K.events_with_sids(events(spark, folder), sids(spark, folder)), "sid", 150, min_length=2)
    tokens = lambda c: F.transform(c, lambda x: (x + FIRST_TOKEN).cast("int"))
    target = F.concat(tokens(F.element_at("chain", -1)), F.array(F.lit(EOS_TOKEN)))
    return chained.select(
        "user_id", X.pad_to(tokens(F.flatten("chain")), PAD_TOKEN, MAX_INPUT).alias("input_ids"), X.mask_labels(X.pad_to(target, PAD_TOKEN, MAX_TARGET), PAD_TOKEN, MAX_TARGET).alias("labels"),
        F.least(4 * F.size("chain"), F.lit(MAX_INPUT)).alias("n_input"),
    )


def token_vocabulary(spark, folder):
    """P26."""
    return S.vocabulary(spark, 1024, 32_100)


QUERIES = {
    f.__name__: f
    for f in (clean_text, strip_markup, clean_documents, metadata_prompts, sid_strings, shard_paths, first_elements, prompt_periods, label_masks, token_vocabulary)
}
SQL = {
    "clean_text": f"SELECT item_id, {clean_sql('title', 200)} AS title, {clean_sql('description', 500)} AS description FROM catalog",
    "strip_markup": f"SELECT item_id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '<[^>]+>', ' ', 'g'), '{SPACE}', ' ', 'g')) AS title FROM catalog",
    "metadata_prompts": f"""
SELECT item_id, '<seq> ' || concat_ws(' | ', 'title: ' || t, CASE WHEN coalesce(sub_category, '') <> '' AND lower(sub_category) <> 'unknown' THEN 'category: ' || sub_category END,
       CASE WHEN d <> '' THEN 'description: ' || d END) AS input_text
FROM (SELECT item_id, sub_category, {clean_sql('title', 500)} AS t, {clean_sql('description', 500)} AS d FROM catalog)""",
    "sid_strings": SID + """
SELECT item_id, t || '<sid_eos>' AS target_text, [sid_0, sid_1, sid_2, sid_3] AS sid, [sid_0, sid_1, -1, -1] AS padded
FROM (SELECT *, '<sid_' || sid_0 || '><sid_' || sid_1 || '><sid_' || sid_2 || '><sid_' || sid_3 || '>' AS t FROM item2feat)""",
    "shard_paths": "SELECT item_id, 'images/' || printf('%03d', CASE WHEN item_id < 1000 THEN item_id ELSE item_id // 1000 END) || '/' || item_id || '.jpg' AS path FROM catalog",
    "first_elements": "SELECT item_id, [x FOR x IN categories IF contains(x, '&')][1] AS with_and, coalesce(categories[2], '') AS second FROM catalog",
    "prompt_periods": "SELECT item_id, CASE WHEN ends_with(coalesce(description, ''), '.') THEN description ELSE coalesce(description, '') || '.' END AS prompt FROM catalog",
    "label_masks": SID + f""", e AS ({EVENTS}), h AS (SELECT e.*, sid_0, sid_1, sid_2, sid_3, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ms DESC, ordinal DESC) AS f FROM e JOIN item2feat USING (item_id)),
c AS (SELECT user_id, flatten(list([sid_0, sid_1, sid_2, sid_3] ORDER BY timestamp_ms, ordinal)) AS ids, count(*) AS n FROM h WHERE f <= 150 GROUP BY 1 HAVING count(*) >= 2)
SELECT user_id, list_resize([CAST(x + {FIRST_TOKEN} AS INT) FOR x IN ids][1:{MAX_INPUT}], {MAX_INPUT}, {PAD_TOKEN}) AS input_ids,
       list_resize(list_concat([CAST(x + {FIRST_TOKEN} AS INT) FOR x IN ids[-4:]], [{EOS_TOKEN}]), {MAX_TARGET}, -100) AS labels, CAST(least(4 * n, {MAX_INPUT}) AS INT) AS n_input FROM c""",
    "token_vocabulary": """
SELECT '<sid_' || i || '>' AS token, i + 32100 AS token_id, i AS code FROM range(1024) t(i)
UNION ALL SELECT * FROM (VALUES ('<sid_pad>', 33124, NULL), ('<sid_eos>', 33125, NULL), ('<seq>', 33126, NULL), ('<search>', 33127, NULL)) v(token, token_id, code)""",
}
