"""The llm operators on the given tables, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.cluster import scratch_path, ship_package
from musterline.llm import (
    chat,
    decontamination,
    fingerprints,
    lines,
    merkle,
    pieces,
    quality,
    simhash,
    suffixes,
    token_files,
    toxicity,
    urls,
    variants,
)
from musterline.llm.tables import bound_batches, table

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabulary files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package()
            bound_batches(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check.strip()
        return build

    return register


@query("op1_document_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(table(spark, folder, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_simhash_components")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.components(table(spark, folder, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op7_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), 10) AS size
          FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS span
           FROM (SELECT item_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM b)),
    dw AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS span
           FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p
                 FROM d CROSS JOIN (SELECT DISTINCT size FROM b) WHERE len(w) >= size)),
    hit AS (SELECT dw.doc_id, bw.item_id, dw.size, dw.p FROM dw JOIN bw ON dw.size = bw.size AND dw.span = bw.span),
    covered AS (SELECT doc_id, count(DISTINCT q) AS n
                FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id),
    item AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(item.ids, '')) AS items_sha256,
           coalesce(covered.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.size("hit_words").cast("bigint")
    return rows.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op9_sentencepiece_roundtrip")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text")
    rows = pieces.encoded(rows, f"{TOKENIZERS}/piece_bpe_32k.model")
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op10_line_dedup",
    """
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS i
               FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    k AS (SELECT doc_id, i, line, row_number() OVER w AS j, count(*) OVER (PARTITION BY doc_id) AS n,
                 len(regexp_extract_all(line, '[^ \t\r]+')) AS words
          FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    near AS (SELECT *, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3,
                   words + lead(words) OVER w AS words2
            FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
    win AS (SELECT *, CASE WHEN j = 1 THEN least(n, 3) ELSE 3 END AS size FROM near
            UNION SELECT *, CASE WHEN words > 50 THEN 1 ELSE 2 END AS size FROM near WHERE words > 50 OR words2 > 50),
    whole AS (SELECT doc_id, i AS first, CASE size WHEN 1 THEN i WHEN 2 THEN i2 ELSE i3 END AS last, size, line AS a,
                     CASE WHEN size > 1 THEN line2 END AS b, CASE WHEN size > 2 THEN line3 END AS c
              FROM win WHERE j + size - 1 <= n),
    earliest AS (SELECT size, a, b, c, min({'d': doc_id, 'f': first}) AS e FROM whole GROUP BY size, a, b, c),
    later AS (SELECT w.doc_id, w.first, w.last FROM whole w JOIN earliest e
              ON w.size = e.size AND w.a = e.a AND w.b IS NOT DISTINCT FROM e.b AND w.c IS NOT DISTINCT FROM e.c
              WHERE {'d': w.doc_id, 'f': w.first} > e.e),
    gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
    marked AS (SELECT l.doc_id, l.line, l.i, g.i IS NOT NULL AS removed,
                      g.i IS NOT NULL AND (g.i - 1) NOT IN (SELECT x.i FROM gone x WHERE x.doc_id = l.doc_id) AS opens
               FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    total = F.size(F.split(F.coalesce("original", F.lit("")), "\n", -1)).cast("bigint")
    return rows.select(
        "doc_id",
        total.alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query(
    "op4_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, hash(substring(h, 2 * i + 1, 400)) AS k
          FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
    hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    opened AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS opens FROM hit),
    numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
    cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last,
                   string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
           coalesce(spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffixes.without_repeats(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "tokens")
    order = token_files.write_token_files(
        table(spark, folder, "documents"), files, f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    )
    return order.join(token_files.document_lengths(spark, files), ["file", "ordinal"]).select("doc_id", "n_tokens")


@query(
    "op6_perspective_rotation",
    """
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
    s AS (SELECT t.conv_id, perspective, turn, role, text, role = perspective AS own,
                 CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                      ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' END || chr(10) AS head,
                 replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    o AS (SELECT *, row_number() OVER w AS position,
                 CAST(sum(length(head) + length(body)) OVER w AS BIGINT) AS until
          FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, perspective, position, turn, role, head || body AS segment,
           until - length(head) - length(body) AS start,
           CASE WHEN own THEN until - length(body) END AS mask_start, CASE WHEN own THEN until END AS mask_end
    FROM o
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(table(spark, folder, "conversations"))


def _url_check() -> str:
    """The rules, the two models order by order, and the threshold as SQL."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        domain, _, rest = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{rest}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)

    def chance(count: str, total: str, kinds: str, lower: str) -> str:
        return f"CASE WHEN {total} + {kinds} > 0 THEN ({count} + {kinds} * {lower}) / ({total} + {kinds}) ELSE {lower} END"

    orders = []
    for k in range(urls.CONTEXT + 1):
        columns = []
        for c in ("allow", "block"):
            lower = (f"1.0e0 / {urls.CHARACTERS}",) * 2 if k == 0 else (f"q.{c}_p", f"q.{c}_q")
            columns.append(f"{chance(f'c.{c}', f't.{c}', f't.{c}_kinds', lower[0])} AS {c}_p")
            less = f"greatest(c.{c} - 1, 0)", f"greatest(t.{c} - 1, 0)", f"(t.{c}_kinds - (c.{c} = 1)::INT)"
            columns.append(f"{chance(*less, lower[1])} AS {c}_q")
        shorter = f"JOIN p{k - 1} q ON q.g = substring(c.g, 2, {k})" if k else ""
        orders.append(f"""c{k} AS (SELECT substring(gram, {urls.CONTEXT + 1 - k}, {k + 1}) AS g, sum(allow)::DOUBLE AS allow,
              sum(block)::DOUBLE AS block FROM counts GROUP BY 1),
            t{k} AS (SELECT substring(g, 1, {k}) AS g, sum(allow) AS allow, sum(block) AS block,
              count(*) FILTER (allow > 0) AS allow_kinds, count(*) FILTER (block > 0) AS block_kinds FROM c{k} GROUP BY 1),
            p{k} AS MATERIALIZED (SELECT c.g, {', '.join(columns)}
              FROM c{k} c JOIN t{k} t ON t.g = substring(c.g, 1, {k}) {shorter})""")
    ratio = " ".join(
        f"WHEN decided {test} THEN ln({a}) - ln({b})"
        for test, a, b in (("= 'allow'", "allow_q", "block_p"), ("= 'block'", "allow_p", "block_q"), ("IS NULL", "allow_p", "block_p"))
    )
    return f"""
    WITH cut_out AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest
        FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
    named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut_out),
    ruled AS (SELECT *, CASE {rule} END AS rule FROM named),
    parts AS MATERIALIZED (SELECT *, CASE rule {verdict} END AS decided, host || path AS text FROM ruled),
    texts AS (SELECT text, decided, count(*) AS n FROM parts GROUP BY ALL),
    grams AS MATERIALIZED (SELECT text, decided, n, substring(repeat(chr(2), {urls.CONTEXT}) || text || chr(3), i, {urls.CONTEXT + 1}) AS gram
        FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM texts)),
    counts AS MATERIALIZED (SELECT gram, coalesce(sum(n) FILTER (decided = 'allow'), 0) AS allow,
        coalesce(sum(n) FILTER (decided = 'block'), 0) AS block FROM grams GROUP BY 1),
    {', '.join(orders)},
    scores AS MATERIALIZED (SELECT text, decided, n, sum(CAST(round(own * {urls.UNITS}) AS BIGINT)) / count(*) / {urls.UNITS} AS score
        FROM (SELECT text, decided, n, CASE {ratio} END AS own FROM grams JOIN p{urls.CONTEXT} ON g = gram) GROUP BY ALL),
    steps AS (SELECT CAST(round(least(greatest(score, -{urls.LIMIT}), {urls.LIMIT}) * {urls.STEPS}) AS INT) AS step,
        coalesce(sum(n) FILTER (decided = 'allow'), 0) AS allow, coalesce(sum(n) FILTER (decided = 'block'), 0) AS block
        FROM scores WHERE decided IS NOT NULL GROUP BY 1),
    tried AS (SELECT step, coalesce(sum(allow) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(allow) OVER ()
          + sum(block) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(block) OVER () AS errors,
        sum(allow) OVER () * sum(block) OVER () > 0 AS both_kinds FROM steps),
    chosen AS (SELECT coalesce((SELECT (step - 0.5e0) / {urls.STEPS} FROM tried WHERE both_kinds ORDER BY errors, step LIMIT 1), 0) AS cut)
    SELECT page_id, host, path, rule, coalesce(p.decided, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
    FROM parts p JOIN scores s ON p.text = s.text AND p.decided IS NOT DISTINCT FROM s.decided, chosen
    """


@query("op8_url_filter", _url_check())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = urls.judged(table(spark, folder, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


CRC_TABLE_SQL = """crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n))"""


def crc32_sql(text: str) -> str:
    """The crc32 of a text of code points below 2048, with the list ``t`` of ``CRC_TABLE_SQL`` at hand."""
    utf8 = f"""flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]
        ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"""
    return f"xor(4294967295, list_reduce({utf8}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


@query(
    "op11_spelling_variants",
    f"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text,
        '[A-Za-z\u00C0-\u00FF]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc),
    cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    less AS MATERIALIZED (SELECT DISTINCT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
    one_way AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
        UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
    near AS (SELECT o.word, count(*) AS n_near, min({{'m': -n, 'w': near}}) AS best FROM one_way o JOIN words w ON o.near = w.word GROUP BY o.word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.w END AS form,
        CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM words w LEFT JOIN near USING (word)),
    chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = variants.grouped(table(spark, folder, "documents"), altered=31)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_toxicity")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _merkle_check() -> str:
    def hashed(text: str) -> str:
        sized = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
        return f"sha256({' || '.join(sized.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    def tree(name: str, start: str) -> str:
        """The nodes of all levels over the rows (k, pos, digest, many) of ``start``, with their siblings."""
        run = "OVER (PARTITION BY k, level, pos // 3 ORDER BY pos ROWS BETWEEN"
        return f"""{name}_nodes AS (SELECT k, 0 AS level, pos, digest, many FROM {start} UNION ALL
            SELECT k, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(many) + 2) // 3
            FROM {name}_nodes WHERE many > 1 GROUP BY k, level, pos // 3),
        {name}_sides AS (SELECT k, level, pos, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}_nodes WHERE many > 1)"""

    changed = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    return f"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS k, {hashed('text')} AS digest, {hashed('other')} AS altered
        FROM (SELECT *, {changed} AS other FROM documents, crc)),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY k) AS many FROM d),
    {tree('own', 'placed')},
    sub AS MATERIALIZED (SELECT k AS name, digest AS subroot FROM own_nodes WHERE many = 1),
    subs AS (SELECT 0 AS k, name, row_number() OVER (ORDER BY encode(name)) - 1 AS pos, subroot AS digest, count(*) OVER () AS many FROM sub),
    {tree('top', 'subs')},
    steps AS (SELECT r, s.level, before, after FROM placed p JOIN own_sides s ON p.k = s.k AND p.pos // CAST(pow(3, s.level) AS BIGINT) = s.pos
        UNION ALL SELECT r, 1000 + s.level, before, after FROM placed p JOIN subs u ON p.k = u.name
        JOIN top_sides s ON u.pos // CAST(pow(3, s.level) AS BIGINT) = s.pos),
    ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS i FROM steps),
    fold AS (SELECT r, 0 AS i, altered AS acc FROM placed UNION ALL
        SELECT f.r, o.i, sha256(before || acc || after) FROM fold f JOIN ordered o ON f.r = o.r AND o.i = f.i + 1),
    ended AS (SELECT r, arg_max(acc, i) AS folded_root FROM fold GROUP BY r),
    proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY i)) AS p FROM ordered GROUP BY r)
    SELECT doc_id, p.digest AS leaf, subroot, t.digest AS root, coalesce(proof.p, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
    FROM placed p JOIN sub ON p.k = sub.name JOIN ended USING (r) LEFT JOIN proof USING (r), (SELECT digest FROM top_nodes WHERE many = 1) t
    """


@query("op13_merkle_manifest", _merkle_check())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    id_text = F.col("doc_id").cast("string").cast("binary")
    without_breaks = F.when(F.crc32(id_text) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows = merkle.verified(table(spark, folder, "documents"), without_breaks)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
