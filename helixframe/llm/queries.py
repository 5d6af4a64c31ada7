"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, langid, licenses, near_dedup, packing, pieces, quality, spelling, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two crawls of all pages as WARC-like records.

    Page n is fetched in minute n and answered in full; a day later it is asked
    for again and answered 304, with the entity tag of that fetch where the URL
    is https, else with its time of modification.
    """
    at, again = F.col("page_id") * 60, F.col("page_id") * 60 + 86_400
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    by_tag = F.col("url").startswith("https:")
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), at.cast("string"),
            F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), at.cast("string"),
        ).alias("headers"), F.col("html").alias("body"),
    )
    answer = F.create_map(
        F.when(by_tag, "ETag").otherwise("Last-Modified"), F.when(by_tag, tag).otherwise(at.cast("string")),
        F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Connection"), F.lit("close"), F.lit("Date"), again.cast("string"),
    )
    later = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), answer.alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.unionAll(later)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k)))
    return found.select(
        "record_id", "url_key", "ts", "response_id", "state", F.array_join(lines, "\n").alias("headers"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"), F.octet_length("body").cast("long").alias("body_bytes"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.language_id(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), typo_every=97)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_repair(table(spark, sf_dir, "conversations"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pieces": op13_pieces,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """The base phrases by place, and every block of licenses.license_scan against every template, without filters."""
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    words = [[w.decode() for line in licenses.lines_of(t) for w in line] for _, t in licenses.TEMPLATES]
    templates = ", ".join(f"({k}, '{label}', [{quoted(sorted(set(w)))}], {licenses.span_of(len(w))})" for k, ((label, _), w) in enumerate(zip(licenses.TEMPLATES, words)))
    phrases = ", ".join(f"([{quoted(p.split())}], '{label}')" for p, label in licenses.PHRASES.items())
    half = max(licenses.span_of(len(w)) for w in words)
    return rf"""
        WITH RECURSIVE tpl(t, label, words, span) AS (VALUES {templates}), phrase(words, label) AS (VALUES {phrases}),
        part_of AS (SELECT a.t AS small, b.t AS large FROM tpl a JOIN tpl b ON len(list_intersect(a.words, b.words)) = len(a.words) AND len(a.words) < len(b.words)),
        d AS (SELECT row_number() OVER () AS k, doc_id, {_LOWER} AS x FROM documents),
        w AS (SELECT k, doc_id, x, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
        found AS (SELECT k, unnest(range(len(w.words))) AS pos, label, w.words AS words, p.words AS pw FROM w, phrase p WHERE list_has_all(w.words, p.words)),
        base AS (SELECT k, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM found WHERE words[pos + 1 : pos + len(pw)] = pw GROUP BY k),
        lines AS (SELECT k, regexp_extract_all(unnest(string_split(x, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM w UNION ALL SELECT k, words FROM w),
        block AS (SELECT k, row_number() OVER () AS b, list_distinct(words[s + 1 : s + {2 * half}]) AS have, words[s + 1 : s + {2 * half}] AS run FROM (SELECT *, unnest(range(0, greatest(1, len(words) - {half}), {half})) AS s FROM lines)),
        near AS (SELECT k, b, t, label, words, span, run FROM block, tpl WHERE len(list_intersect(have, words)) >= greatest(1, ceil({licenses.CONTAINED} * len(words) - 1e-9))),
        dense AS (SELECT k, b, t, label, words, list_max(list_transform(range(0, greatest(1, len(run) - span + 1)), lambda s: len(list_intersect(list_distinct(run[s + 1 : s + span]), words)))) AS n FROM near),
        met AS (SELECT k, b, t, label, n / len(words) AS part FROM dense WHERE n >= greatest(1, ceil({licenses.CONTAINED} * len(words) - 1e-9))),
        own AS (SELECT k, label FROM met m WHERE NOT EXISTS (SELECT 1 FROM met o JOIN part_of ON large = o.t WHERE o.b = m.b AND small = m.t)),
        every AS (SELECT k, label FROM own UNION SELECT k, unnest(labels) FROM base), l AS (SELECT k, array_to_string(list_sort(list(label)), ',') AS labels FROM every GROUP BY k),
        best AS (SELECT k, max(part) AS part FROM met GROUP BY k)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
               coalesce(l.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.part, 0.0) END AS score
        FROM w LEFT JOIN base USING (k) LEFT JOIN l USING (k) LEFT JOIN best USING (k)
    """


#: crc32 of a text: the bytes of its UTF-8 through a table of 256 remainders, which ``_CRC_TABLE`` builds by their rule.
_CRC_TABLE = "crc(t) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    code = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {code}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
        uses AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS k, count(*) AS n FROM runs GROUP BY ALL),
        hashed AS (SELECT r, n, {_crc("k")} AS h FROM uses, crc),
        words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1),
        w AS (SELECT word, n FROM words WHERE n >= 3 AND length(word) >= 5),
        less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
                 UNION SELECT l.word, w.word FROM less l JOIN w ON l.d = w.word UNION SELECT w.word, l.word FROM less l JOIN w ON l.d = w.word),
        best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS m, arg_min(o.word, (-o.n, o.word)) AS b FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
    """,
    "op12_conversation_repair": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        kinds AS (SELECT *, {_crc("key")} % 20 AS k FROM keyed, crc),
        bad AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE k <> 0),
        ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
        r AS (SELECT c, turn, role, text, substr(role, 1, 1) AS x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p FROM bad JOIN ids ON ids.conv_id IS NOT DISTINCT FROM bad.conv_id),
        own AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 AS again, lag(x) OVER (PARTITION BY c ORDER BY p) AS px FROM r),
        fault AS (SELECT *, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f FROM own),
        counts AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate,
                          count(*) FILTER (f = 3) AS truncated, count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY c),
        follows(i, x, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        put(i, j, price, said, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']),
                       (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
        edit AS (SELECT c, p, i, i AS j, 4 AS price, 'D' AS said, []::VARCHAR[] AS lines FROM fault, (SELECT DISTINCT i FROM put)
                 UNION ALL SELECT c, p, i, j, CASE f WHEN 3 THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM fault JOIN follows USING (x) WHERE f NOT IN (1, 2)
                 UNION ALL SELECT c, p, i, i, CASE f WHEN 3 THEN 3 ELSE 0 END, 'K', [':' || text] FROM fault, (SELECT DISTINCT i FROM put) WHERE f NOT IN (1, 2) AND x = ''
                 UNION ALL SELECT c, p, i, j, CASE f WHEN 3 THEN 6 ELSE 3 END, 'R', [CASE follows.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM fault, follows WHERE f NOT IN (1, 2) AND follows.x <> 's'),
        go AS (SELECT c, p, e.i, put.j, min({{'price': e.price + put.price, 'said': e.said || put.said, 'lines': e.lines || put.lines}}) AS e FROM edit e JOIN put ON e.j = put.i GROUP BY ALL),
        path AS (SELECT c, 0::BIGINT AS p, j AS s, price AS cost, said AS audit, lines FROM ids, put WHERE i = 0
                 UNION ALL SELECT c, p, s, b.cost, b.audit, b.lines FROM (SELECT path.c AS c, path.p + 1 AS p, go.j AS s,
                     min({{'cost': path.cost + go.e.price, 'audit': path.audit || go.e.said, 'lines': path.lines || go.e.lines}}) AS b
                     FROM path JOIN go ON go.c = path.c AND go.p = path.p + 1 AND go.i = path.s GROUP BY path.c, path.p, go.j)),
        done AS (SELECT path.c, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS b FROM path LEFT JOIN counts USING (c) WHERE p = coalesce(n, 0) AND s IN (0, 3) GROUP BY path.c)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
        FROM ids JOIN done USING (c) LEFT JOIN counts USING (c)
    """,
    "op7_license_scan": _license_sql(),
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
        root AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN root USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op4_warc_revisits": r"""
        WITH bare AS (
            SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages
        ), cut AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
                      || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS q
            FROM bare
        ), p AS (
            SELECT page_id, url, html, place || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key,
                   '"' || md5(coalesce(html, '')) || '"' AS tag, page_id * 60 AS mt, url LIKE 'https:%' AS by_tag
            FROM cut
        ), r AS (
            SELECT page_id * 2 AS record_id, url_key, mt AS ts, 'response' AS kind, tag, mt, by_tag, html FROM p WHERE html IS NOT NULL
            UNION ALL
            SELECT page_id * 2 + 1, url_key, mt + 86400, 'revisit', tag, mt, by_tag, NULL FROM p
        ), j AS (
            SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'tag': tag, 'mt': mt, 'html': html} END IGNORE NULLS)
                OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
            FROM r
        ), k AS (
            SELECT *, CASE WHEN s IS NULL THEN 'no_response' WHEN by_tag THEN CASE WHEN tag = s.tag THEN 'resolved' ELSE 'changed' END
                           WHEN mt = s.mt THEN 'resolved' ELSE 'changed' END AS state
            FROM j WHERE kind = 'revisit'
        )
        SELECT record_id, url_key, ts, s.id AS response_id, state,
               CASE WHEN state = 'resolved'
                    THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(s.html) || chr(10) || 'content-type: text/html' || chr(10)
                         || 'date: ' || ts || chr(10) || 'etag: ' || s.tag || chr(10) || 'last-modified: ' || s.mt
                    ELSE 'cache-control: max-age=120' || chr(10) || 'date: ' || ts || chr(10)
                         || CASE WHEN by_tag THEN 'etag: ' || tag ELSE 'last-modified: ' || mt END END AS headers,
               CASE WHEN state = 'resolved' THEN md5(s.html) END AS body_md5, CASE WHEN state = 'resolved' THEN strlen(s.html) END AS body_bytes
        FROM k
    """,
}
