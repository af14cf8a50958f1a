"""The opN queries: each applies its operator with production parameters to its whole table.

ORACLE_SQL has DuckDB SQL for those that SQL can express; the others are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorweft.llm import decontam, htmlwrap, mixing, pii, quality, secrets, simhash, substrings, urlfilter, warc
from tensorweft.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.archive(table(spark, sf_dir, "pages"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    located = warc.locate(packages.repartition(n, "path")).repartition(n, "path", "start")
    return warc.read_records(located, payloads=False).drop("url")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = urlfilter.train(pages.select("url", urlfilter.seed_label(F.col("url")).alias("label")))
    return urlfilter.judge(pages, model, keep=["page_id"])


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_simhash, op3_pii, op4_decontamination, op5_url_filter, op6_html, op7_quality, op8_substring_dedup, op9_secrets, op10_mixing)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""

ORACLE_SQL["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
marks AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS w FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

ORACLE_SQL["op8_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM w JOIN f ON w.g = f.g WHERE least < doc_id),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS k FROM d),
left_ AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.k) AS t, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k WHERE g.k IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_ ON d.doc_id = left_.doc_id
"""


def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _apportioned(units: str, votes: str, seats: str, group: str, key: str, out: str) -> str:
    over = f"PARTITION BY {group}" if group else ""
    return f"""(
  SELECT {{cols}}, CAST(low_ + sum(won_) AS BIGINT) AS {out} FROM (
      SELECT *, CASE WHEN row_number() OVER ({over} ORDER BY v_ / (2 * k_ + 1) DESC, {key}, k_) <= left_ THEN 1 ELSE 0 END AS won_ FROM (
        SELECT *, unnest(generate_series(low_, high_)) AS k_ FROM (
          SELECT *, {seats} - sum(low_) OVER ({over}) AS left_ FROM (
            SELECT *, CAST(greatest(0, floor(fair_ * (1 - slack_) - 1.5)) AS BIGINT) AS low_, CAST(ceil(fair_ * (1 + slack_)) + 2 AS BIGINT) AS high_ FROM (
              SELECT *, CASE WHEN sum_ > 0 THEN v_ * {seats} / sum_ ELSE 0 END AS fair_, CASE WHEN {seats} > 0 THEN n_ / (2.0 * {seats}) ELSE 0 END AS slack_ FROM (
                SELECT *, sum(v_) OVER ({over}) AS sum_, count(*) OVER ({over}) AS n_ FROM (SELECT *, CAST({votes} AS DOUBLE) AS v_ FROM {units})))))))
  GROUP BY {{cols}}, low_)"""


ORACLE_SQL["op10_mixing"] = f"""
WITH r AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, count(*) AS n FROM r GROUP BY source),
s1 AS (SELECT *, CAST([{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST({mixing.MOST} * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS stop, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.PERCENT} / 100 AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM s2
  WINDOW b AS (ORDER BY stop, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max(CASE WHEN stop >= level THEN level END) OVER () AS line FROM s3),
s5 AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, n, CASE WHEN line IS NULL THEN cap ELSE least(cap, line * weight) END AS target, CAST(floor(total / {mixing.BLOCK} + 0.5) AS BIGINT) AS seats FROM s4),
s6 AS (SELECT * FROM {_apportioned('s5', 'target', 'seats', '', 'source IS NULL, source', 'blocks').replace('{cols}', 'source, source_size, n, target, seats')}),
d AS (SELECT r.doc_id, r.source, r.size, source_size, target, blocks,
  {_drawn("'shard'", "coalesce(CAST(doc_id AS VARCHAR), 'size ' || size)")} % CAST(ceil(n / {float(mixing.SHARD)}) AS BIGINT) AS shard,
  {_drawn("'order'", "coalesce(CAST(doc_id AS VARCHAR), 'size ' || size)")} AS place
  FROM r JOIN s6 ON r.source IS NOT DISTINCT FROM s6.source),
q0 AS (SELECT source, shard, blocks, CAST(sum(size) AS BIGINT) AS shard_size FROM d GROUP BY ALL),
g0 AS (SELECT source, shard // {mixing.GROUP} AS grp, blocks, CAST(sum(shard_size) AS BIGINT) AS grp_size FROM q0 GROUP BY ALL),
g1 AS (SELECT * FROM {_apportioned('g0', 'grp_size', 'blocks', 'source', 'grp', 'seats').replace('{cols}', 'source, grp, blocks, grp_size')}),
g2 AS (SELECT q0.source, shard, g1.grp, g1.seats, shard_size FROM q0 JOIN g1 ON q0.source IS NOT DISTINCT FROM g1.source AND q0.shard // {mixing.GROUP} = g1.grp),
q1 AS (SELECT * FROM {_apportioned('g2', 'shard_size', 'seats', 'source, grp', 'shard', 'quota').replace('{cols}', 'source, shard, grp, seats, shard_size')}),
q2 AS (SELECT *, CAST(least(quota * {mixing.BLOCK}, {mixing.MOST} * shard_size) AS BIGINT) AS words,
  {mixing.BLOCK} * ({_drawn("'first'", "coalesce(source, '')", 'CAST(shard AS VARCHAR)')} % greatest(1, CAST(ceil(shard_size / {float(mixing.BLOCK)}) AS BIGINT))) AS first FROM q1),
q3 AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes FROM q2),
q4 AS (SELECT source, shard, shard_size, passes, first, words - passes * shard_size AS rest FROM q3),
e AS (SELECT d.*, shard_size, passes, first, first + rest AS stop_, CAST(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_
  FROM d JOIN q4 ON d.source IS NOT DISTINCT FROM q4.source AND d.shard = q4.shard)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(end_, stop_, shard_size) - greatest(end_ - size, first)) + greatest(0, least(end_, stop_ - shard_size) - greatest(end_ - size, 0)) AS BIGINT) AS taken
FROM e
"""
