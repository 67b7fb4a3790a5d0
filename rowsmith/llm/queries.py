"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries.common import table
from . import decontamination, langid, main_text, manifest, mixing, pieces, quality, simhash, spelling, substring, toxicity, vectors, warc
from .learning import remainder


def op6_simhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4, seed=42)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op1_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"), shingle=5, similarity=0.8)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "shared", F.col("size").alias("item_shingles"), "containment")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.learn(docs, table(spark, sf, "labels"), label_col="quality", only=remainder("doc_id", 3) != 1)
    return _scored(quality.score(docs.select("doc_id", "text"), model), remainder("doc_id", 3) == 1, 0.5)


def _scored(found: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    """Digest columns of a score; a null id belongs to no fold and is not held out."""
    return found.select("row.doc_id", "score").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf: str, model_path: str = PIECE_MODEL) -> DataFrame:
    model = pieces.read_model(model_path)
    back = pieces.encode_and_decode(table(spark, sf, "documents").select("doc_id", "text"), model)
    # what comes back: the text, with blank marks in it read as blanks
    same = F.col("decoded").eqNullSafe(F.translate("row.text", pieces.BLANK, " "))
    return back.select("row.doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("pieces_hash"), same.alias("round_trip"))


def op4_warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf, "pages"), payloads=False, least_bytes=1000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf, "documents"), window=35)
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = main_text.extract(pages.select("page_id", "url", "html"), main_text.learn(pages))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_embedding_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of the nearest centroid, how far it is, and whether that is too far for it."""
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.where(remainder("doc_id", 3) != 1), key=F.col("doc_id"), limits=True)
    held_out = F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out")
    found = langid.identify(docs.select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out")), model)
    return found.select("row.*", "nearest", "score", "rejected").select(
        "doc_id", held_out, F.col("nearest").alias("lang_pred"), "score", (1 - F.col("score")).alias("distance"), "rejected"
    )


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs, table(spark, sf, "labels"), label_col="toxic", only=remainder("doc_id", 4) != 2)
    return _scored(toxicity.score(docs.select("doc_id", "text"), model), remainder("doc_id", 4) == 2, 0.3)


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's leaf with its proof; the leaves of some are tampered with and must not verify."""
    crc = F.crc32(F.col("doc_id").cast("string"))

    def leaf(n_chars: Column) -> list[Column]:
        return [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]

    tampered = F.when((crc % 7 == 0) & F.col("n_chars").isNotNull(), manifest.digest_of(leaf(F.col("n_chars") + 1)))
    found = manifest.manifest(
        table(spark, sf, "documents"), leaf(F.col("n_chars")), group=F.col("lang"), order=F.col("doc_id"), carry={"tampered": tampered},
    )
    shown = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return shown.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_mixed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix of the sources by weights 3, 1, 2, .. takes of each document."""
    found = mixing.mixed(table(spark, sf, "documents"), text="text", source="source", key="doc_id", weights=[3, 1, 2], share=1.5, most=2)
    return mixing.taken(found).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf, "documents"), "doc_id", "text", shortest=5, least=3)
    return spelling.variants(words, times=2)


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc_archives": op4_warc_archives,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_duplicates": op6_simhash_near_duplicates,
    "op7_main_text": op7_main_text,
    "op8_embedding_near_duplicates": op8_embedding_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_mixed_sources": op12_mixed_sources,
    "op13_spelling_variants": op13_spelling_variants,
}

# The distinct runs of five words of a text, A-Z lower-cased.
SHINGLES = """
    SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i
          FROM (SELECT {id} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
                FROM {table}))
"""

# CRC-32 of a text's bytes, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

# A field of a leaf: its length in bytes and its text, or a dash.
FIELD = "coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')"

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        WITH d AS ({SHINGLES.format(id="doc_id", table="documents")}),
             b AS ({SHINGLES.format(id="item_id", table="benchmark")}),
             sizes AS (SELECT id, count(*) AS n FROM b GROUP BY id),
             shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b USING (shingle) GROUP BY 1, 2)
        SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
        FROM shared JOIN sizes ON sizes.id = item_id
        WHERE shared >= ceil(0.8 * n - 1e-9)
    """,
    "op4_warc_archives": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
            FROM pages
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN owner END AS refers_to
        FROM payloads
    """,
    "op5_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
                         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
             again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
             covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE h IN (SELECT h FROM again)),
             numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
             kept AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.p) AS t, count(*) AS n
                      FROM numbered n ANTI JOIN covered c ON n.doc_id = c.doc_id AND n.p = c.p GROUP BY n.doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, n_chars IS NOT NULL AND {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 AS tampered,
                   sha256(concat({FIELD.format(f="doc_id")}, {FIELD.format(f="source")}, {FIELD.format(f="lang")}, {FIELD.format(f="n_chars")}, {FIELD.format(f="text")})) AS leaf,
                   sha256(concat({FIELD.format(f="doc_id")}, {FIELD.format(f="source")}, {FIELD.format(f="lang")}, {FIELD.format(f="(n_chars + 1)")}, {FIELD.format(f="text")})) AS other
            FROM documents
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        nodes AS (
            SELECT lang, 0 AS level, idx, n, leaf AS digest FROM placed
            UNION ALL
            SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n
        ),
        subroots AS (
            SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
        ),
        tops AS (
            SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
        ),
        steps AS (
            SELECT p.doc_id, p.leaf, h.level, xor(p.idx >> h.level, 1) AS beside, coalesce(s.digest, '') AS sibling
            FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) h ON h.lang IS NOT DISTINCT FROM p.lang
            LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = h.level AND s.idx = xor(p.idx >> h.level, 1)
            UNION ALL
            SELECT p.doc_id, p.leaf, 1000 + h.level, xor(r.idx >> h.level, 1), coalesce(s.digest, '')
            FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) h ON true
            LEFT JOIN tops s ON s.level = h.level AND s.idx = xor(r.idx >> h.level, 1)
        ),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level) AS k FROM steps),
        fold AS (
            SELECT doc_id, leaf, 0 AS k, CASE WHEN tampered THEN other ELSE leaf END AS node FROM placed
            UNION ALL
            SELECT f.doc_id, f.leaf, o.k, sha256(CASE WHEN beside % 2 = 0 THEN sibling || node ELSE node || sibling END)
            FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.leaf = f.leaf AND o.k = f.k + 1
        ),
        ends AS (SELECT doc_id, leaf, node FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY k DESC) = 1),
        proofs AS (SELECT doc_id, leaf, sha256(string_agg(sibling, '' ORDER BY k)) AS proof_sha256 FROM ordered GROUP BY doc_id, leaf)
        SELECT p.doc_id, p.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT digest AS root FROM tops WHERE n = 1) ON true
        JOIN ends e ON e.doc_id = p.doc_id AND e.leaf = p.leaf LEFT JOIN proofs f ON f.doc_id = p.doc_id AND f.leaf = p.leaf
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, word, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word FROM documents)
            GROUP BY ALL
        ),
        hashed AS (SELECT word, n, {CRC32.format(text="concat(doc_id, ':', word)")} AS h FROM runs WHERE length(word) >= 5),
        spoiled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        holes AS (SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM cut),
        near AS (
            SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
            UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.less
            UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.less
        ),
        counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
        best AS (SELECT word, other, m FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
        forms AS (
            SELECT w.word, w.n, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n, coalesce(n_near, 0) AS n_near
            FROM words w LEFT JOIN counted USING (word) LEFT JOIN best USING (word)
        ),
        way AS (SELECT word, word AS reached, 0 AS k FROM forms UNION ALL SELECT w.word, f.form, k + 1 FROM way w JOIN forms f ON f.word = w.reached WHERE f.form IS NOT NULL),
        ends AS (SELECT word, reached AS root FROM way QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC) = 1)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
}
