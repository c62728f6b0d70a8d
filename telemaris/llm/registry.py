"""The corpus queries by name, and SQL for those that SQL can say."""

from __future__ import annotations

from telemaris.llm.bm25_search import op2_bm25_search
from telemaris.llm.bpe import op9_bpe
from telemaris.llm.collocations import op12_collocations
from telemaris.llm.decontamination import op11_decontamination
from telemaris.llm.language_id import op3_language_id
from telemaris.llm.mixing import op7_mixing
from telemaris.llm.ngram_join import op8_ngram_join
from telemaris.llm.substring_dedup import op5_substring_dedup
from telemaris.llm.token_store import op1_token_store
from telemaris.llm.toxicity import op10_toxicity
from telemaris.llm.vector_compression import op13_vector_codes
from telemaris.llm.vector_search import op4_vector_search
from telemaris.llm.warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_token_store, op2_bm25_search, op3_language_id, op4_vector_search, op5_substring_dedup, op6_warc, op7_mixing, op8_ngram_join, op9_bpe, op10_toxicity, op11_decontamination, op12_collocations, op13_vector_codes)}

#: Words as rows (doc_id, word, i), i from 1.
WORDS = r"""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
         w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t)
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: One round of op13: the nearest entry of each part, then the floor of the mean of an entry's parts.
ROUND = """,
         a{i} AS (SELECT p, vec_id, r, any_value(x) AS x, min({{'d': xx - 2 * list_inner_product(x, y) + yy, 'e': e}}) AS best FROM x JOIN b{i} USING (p) GROUP BY p, vec_id, r),
         m{i} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS y FROM (SELECT p, best.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(generate_series(1, size)) AS j FROM d) GROUP BY 1, 2, 3) GROUP BY 1, 2),
         b{j} AS (SELECT p, e, coalesce(m{i}.y, b{i}.y) AS y, list_inner_product(coalesce(m{i}.y, b{i}.y), coalesce(m{i}.y, b{i}.y)) AS yy FROM b{i} LEFT JOIN m{i} USING (p, e))"""

ORACLES: dict[str, str] = {
    "op2_bm25_search": WORDS.format(text=LOWER)
    + """,
         f AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
         s AS (SELECT count(*)::DOUBLE AS docs, greatest(1.0, (SELECT count(*) FROM w) / count(*)::DOUBLE) AS mean FROM documents), d AS (SELECT word, count(*) AS df FROM f GROUP BY 1),
         p AS (SELECT f.doc_id, word, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * n / mean)) AS x FROM f JOIN d USING (word) JOIN l USING (doc_id), s),
         r AS (SELECT f.doc_id AS query_id, p.doc_id, round(sum(x), 9) AS score FROM f JOIN p USING (word) WHERE f.doc_id % 20 = 0 AND p.doc_id <> f.doc_id GROUP BY 1, 2)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r) WHERE rank <= 10
    """,
    "op5_substring_dedup": WORDS.format(text="text")
    + """,
         g AS (SELECT doc_id, word, i, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
         d AS (SELECT *, n = 35 AND count(*) OVER (PARTITION BY key, n) > 1 AS again FROM g),
         r AS (SELECT doc_id, word, i, coalesce(max(CASE WHEN again THEN 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM d),
         k AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY 1)
    SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
    """,
    # A digest's hex digits, five at a time, are four characters of base32.
    "op6_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
         h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least FROM p),
         b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 5 * g + 1, 5))::INTEGER >> s) % 32 + 1, 1), '' ORDER BY g, s DESC) AS payload_digest
               FROM h, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS g), (SELECT unnest([15, 10, 5, 0]) AS s) GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
    FROM h JOIN b USING (page_id)
    """,
    "op8_ngram_join": WORDS.format(text=LOWER).replace("WITH t", "WITH RECURSIVE t")
    + """,
         g AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
         s AS (SELECT DISTINCT doc_id, gram FROM g WHERE n = 5 OR i = 1), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
         o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
         l AS (SELECT x, y FROM o JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
         r(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y), m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
    SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id FROM t LEFT JOIN c USING (doc_id) JOIN m ON m.x = t.doc_id
    """,
    "op11_decontamination": r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
         b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(LOWER, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
         s AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
               FROM (SELECT item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
         w AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM t), (SELECT DISTINCT n FROM s) WHERE i + n - 1 <= len(words)),
         h AS (SELECT doc_id, i, n, item FROM w JOIN s USING (n, win)),
         p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY 1),
         k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
    SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM t LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
    """.replace("LOWER", LOWER),
    "op12_collocations": r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(LOWER, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
         g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM w), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(words)),
         f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
         c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
         s AS (SELECT lang, c.phrase, c.k, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
               FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) c
               JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.phrase = array_to_string(c.words[1 : cut], ' ') AND x.k = cut AND y.phrase = array_to_string(c.words[cut + 1 : c.k], ' ') AND y.k = c.k - cut),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
         i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
    """.replace("LOWER", LOWER),
    "op13_vector_codes": """
    WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS q FROM embeddings
               WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
         d AS (SELECT max(len(q)) // 4 AS size FROM k),
         x AS (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, r, p, q[p * size + 1 : (p + 1) * size] AS x FROM k, d, (SELECT unnest([0, 1, 2, 3]) AS p))),
         b0 AS (SELECT p, r - 1 AS e, x AS y, xx AS yy FROM x WHERE r <= 256)"""
    + "".join(ROUND.format(i=i, j=i + 1) for i in range(4))
    + """,
         z AS (SELECT p, vec_id, r, min({'d': xx - 2 * list_inner_product(x, y) + yy, 'e': e}) AS best FROM x JOIN b4 USING (p) GROUP BY p, vec_id, r),
         c AS (SELECT vec_id, r, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY 1, 2),
         h AS (SELECT sha256(string_agg(y[j]::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b4, (SELECT unnest(generate_series(1, size)) AS j FROM d))
    SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id, r), h
    """,
}
