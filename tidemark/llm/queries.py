"""The operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, shared_dir
from . import chat, decontam, imatch, langid, nearjoin, packing, pii, repair, resample, rollup, secretscan, tokenfile, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """A public byte-level BPE file; every machine has the package it comes in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, urlfilter.train(urlfilter.labelled(spark)))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), "a key for tests")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: The tokenizer's file that documents are counted by, and the version that labelled ones are revised to.
OLD_VERSION, NEW_VERSION = "byte_bpe_50k", "words-2"


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in by the ids of a tokenizer; those labelled as poor go, the other labelled ones are counted anew by words; both batches are sent twice, the ledger is folded between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = materialize(rollup.counts(docs.withColumn("new", rollup.counted(docs, NEW_VERSION)), tokenizer_path(), "old"), "counts")
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialize(rows.join(marks, "doc_id"), "labelled")
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    first = rollup.inserted(rows, OLD_VERSION, "old")
    second = rollup.deleted(labelled.where("quality = 0"), OLD_VERSION, "old").unionByName(rollup.revised(labelled.where("quality != 0 or quality is null"), OLD_VERSION, "old", NEW_VERSION, "new"))
    rollup.commit(ledger, "0001", first)
    rollup.fold(spark, ledger)
    for batch, changes in [("0002", second), ("0001", first), ("0002", second)]:
        rollup.commit(ledger, batch, changes)
    return rollup.totals(spark, ledger)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def held_out(key):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_prototypes(docs: DataFrame) -> dict[str, list[float]]:
    """From the text and language of the rows that are not held out."""
    return langid.learn(docs.where(~held_out("doc_id")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return langid.predict(named, language_prototypes(docs), keep=["doc_id", "held_out"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.classes(table(spark, sf_dir, "documents"))


def damaged(chats: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with made-up faults by a checksum of their ids, and how often each is there."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    rows = chats.select("conv_id", "turn", F.when(code == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("times"))
    return rows, F.col("times")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = damaged(table(spark, sf_dir, "conversations"))
    return repair.report(rows, times=times)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.documents(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_imatch_fingerprints": op4_imatch_fingerprints,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_rollup": op7_token_rollup,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_rans_token_files": op13_rans_token_files,
}


#: CRC-32 in DuckDB: one row with the table of 256 values in t, and the value of the UTF-8 bytes of an expression.
CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))"


def crc_sql(text: str) -> str:
    """With the table's row at hand as ``crc``."""
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {each}), lambda c, y: xor(c >> 8, crc.t[(xor(c, y) & 255) + 1])), 4294967295)"


def _repair_sql() -> str:
    """The layers of the Viterbi pass by recursion; a state is its cost in nine digits and the audit string."""
    plus = lambda x, cost, edit: f"lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}'"
    before_u = "least(l.e, l.s, l.a)"
    layer = f"""
        SELECT f.conv_id, f.k, {plus("l.e", 3, "D")} AS e,
            CASE WHEN must OR initial <> 's' THEN {plus("l.s", 3, "D")} ELSE least({plus("l.s", 3, "D")}, {plus("l.e", "late", "K")}) END AS s,
            CASE WHEN must THEN {plus("l.u", 3, "D")} WHEN initial = 'u' THEN least({plus("l.u", 3, "D")}, {plus(before_u, "late", "K")}) ELSE least({plus("l.u", 3, "D")}, {plus(before_u, "(2 + late)", "R")}) END AS u,
            CASE WHEN must THEN {plus("l.a", 3, "D")} WHEN initial = 'a' THEN least({plus("l.a", 3, "D")}, {plus("l.u", "late", "K")}) ELSE least({plus("l.a", 3, "D")}, {plus("l.u", "(2 + late)", "R")}) END AS a
        FROM layers AS l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.k = l.k + 1
    """
    return rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        ids AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS id FROM conversations),
        coded AS (SELECT conv_id, turn, role, text, {crc_sql("id")} % 20 AS code FROM ids, crc),
        damaged AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM coded, (VALUES (1), (2)) AS copies(i) WHERE code <> 0 AND (i = 1 OR code = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, substr(role, 1, 1) AS initial FROM damaged),
        known AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
        f AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CAST(fault = 'truncated' AS BIGINT) AS late FROM known),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        layers AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000000' AS e, '900000000' AS s, '000000002I' AS u, '000000004II' AS a FROM counts
            UNION ALL
            SELECT conv_id, k, e, s, u, least(a, {plus("u", 2, "I")}) AS a FROM (SELECT conv_id, k, e, s, least(u, {plus("least(e, s, a)", 2, "I")}) AS u, a FROM ({layer}))
        ),
        best AS (SELECT counts.*, CAST(substr(least(e, a), 1, 9) AS BIGINT) AS cost, substr(least(e, a), 10) AS audit FROM layers JOIN counts ON counts.conv_id IS NOT DISTINCT FROM layers.conv_id AND counts.n = layers.k),
        edits AS (SELECT conv_id, i, substr(audit, i, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)),
        numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS k FROM edits),
        outs AS (SELECT numbered.conv_id, i, edit, role, text, row_number() OVER (PARTITION BY numbered.conv_id ORDER BY i) AS o FROM numbered LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM numbered.conv_id AND f.k = numbered.k WHERE edit <> 'D'),
        roled AS (SELECT *, CAST(first_value(edit = 'K' AND substr(role, 1, 1) = 's') OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS lead FROM outs),
        lines AS (SELECT conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE edit WHEN 'I' THEN '' ELSE text END), chr(10) ORDER BY i) AS lines FROM roled GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
    """


def _spans_sql() -> str:
    """Spans of each rule: lengths of matches and of the pieces between them, added up."""
    parts = []
    for n, rule in enumerate(secretscan.RULES):
        form = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {n} AS n, '{rule.kind}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{form}')) AS m, unnest(string_split_regex(coalesce(text, ''), '{form}')) AS before, generate_subscripts(string_split_regex(coalesce(text, ''), '{form}'), 1) AS i FROM documents WHERE regexp_matches(coalesce(text, ''), '{form}')")
    groups = " ".join(f"WHEN {n} THEN length(regexp_extract(m, '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})) >= {rule.least}" for n, rule in enumerate(secretscan.RULES))
    return f"""
        WITH found AS ({' UNION ALL '.join(parts)}),
        placed AS (SELECT doc_id, n, kind, m, CAST(sum(length(before)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM found WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)),
        spans AS (SELECT doc_id, n, s, concat(kind, ':', s, ':', s + length(m)) AS span FROM placed WHERE m IS NOT NULL AND CASE n {groups} END),
        sums AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex, string_agg(span, ',' ORDER BY s, n) FILTER (n < {len(secretscan.BASE)}) AS base, string_agg(span, ',' ORDER BY s, n) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN sums USING (doc_id)
    """


SQL: dict[str, str] = {
    "op2_secret_scan": _spans_sql(),
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
        sets AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS k, count(*) AS size FROM sh GROUP BY doc_id),
        reps AS (SELECT k, min(doc_id) AS rep, any_value(size) AS size, count(*) AS n_copies FROM sets GROUP BY k),
        rs AS (SELECT rep, s, size FROM sh JOIN reps ON doc_id = rep),
        pairs AS (SELECT a.rep AS a, b.rep AS b FROM rs a JOIN rs b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
        e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        walk AS (SELECT rep AS x, rep AS y FROM reps UNION SELECT walk.x, e.b FROM walk JOIN e ON e.a = walk.y),
        classes AS (SELECT x AS rep, min(y) AS class_id FROM walk GROUP BY x),
        degrees AS (SELECT a AS rep, count(*) AS n FROM e GROUP BY a)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(degrees.n, 0) AS n_links, coalesce(reps.n_copies, 1) AS n_copies FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN reps ON reps.k = sets.k LEFT JOIN classes ON classes.rep = reps.rep LEFT JOIN degrees ON degrees.rep = reps.rep
    """,
    "op1_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT item, len(w) AS item_words, least(len(w), 10) AS k, p, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win, w FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT k FROM windows),
        places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lengths WHERE len(w) >= k)),
        hits AS (SELECT places.doc_id, places.p, windows.k, windows.item, windows.p AS q FROM places JOIN windows ON places.win = windows.win AND places.k = windows.k),
        words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
        -- the longest verbatim match: hits on one diagonal of a document and an item, one after the other
        diagonal AS (SELECT doc_id, item, p, q, k, p - q - row_number() OVER (PARTITION BY doc_id, item, p - q ORDER BY p) - (p - q) + q AS run FROM hits),
        runs AS (SELECT doc_id, item, min(p) AS p, max(p) - min(p) + max(k) AS n FROM diagonal GROUP BY doc_id, item, p - q, run),
        best AS (SELECT doc_id, n, item, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, TRY_CAST(item AS BIGINT)) AS r FROM runs) WHERE r = 1)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.all_items, '')) AS items_sha256, words.n_hit IS NOT NULL AS contaminated,
            coalesce(best.n, 0) AS longest_match, best.item AS longest_item, best.p - 1 AS longest_at
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
    """,
    "op11_conversation_repair": _repair_sql(),
    "op12_importance_resampling": rf"""
        WITH crc AS ({CRC_TABLE}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS x FROM d),
        bw AS (SELECT unnest(w) AS x FROM b),
        k AS (SELECT x, {crc_sql("x")} % 10000 AS k FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc),
        s AS (SELECT k, count(*) AS s FROM dw JOIN k USING (x) GROUP BY k),
        t AS (SELECT k, count(*) AS t FROM bw JOIN k USING (x) GROUP BY k),
        totals AS (SELECT (SELECT count(*) FROM dw) AS cs, (SELECT count(*) FROM bw) AS ct),
        gain AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (cs + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (ct + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM (SELECT DISTINCT k FROM k) LEFT JOIN s USING (k) LEFT JOIN t USING (k), totals),
        means AS (SELECT doc_id, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN k USING (x) JOIN gain USING (k) GROUP BY doc_id),
        scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN means USING (doc_id)),
        ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT scored.doc_id, n_features, weight, score, ranks.rank FROM scored LEFT JOIN ranks ON ranks.doc_id = scored.doc_id AND ranks.rank <= 10 * n // 100
    """,
    "op10_chat_format": """
        WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, md5(concat(role, '|', text)) AS h FROM conversations),
        p AS (SELECT conv_id, k, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY k) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
        whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY prefix, n),
        stay AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = whole.prefix))
        SELECT t.conv_id, CAST(floor(t.turn / 256.0) AS BIGINT) AS part, stay.n AS n_turns, stay.n_copies, string_agg(concat('<|', replace(t.role, '<|', '< |'), '|>\n', replace(t.text, '<|', '< |'), '<|end|>\n'), '' ORDER BY t.k) AS rendered
        FROM t JOIN stay ON t.conv_id = stay.conv_id GROUP BY t.conv_id, part, stay.n, stay.n_copies
    """.replace("\\n", "\n"),
}
