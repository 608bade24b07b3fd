"""The pN_ queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import consensus, content, groups, leakage, lookalike, mixing, overlap, personal, splits
from quern.labels import LABELS
from quern.workspace import Workspace, table


# A public tokenizer's file on the machines that run the registered queries.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def queries() -> dict:
    return {
        "p1_found": lambda s, d: content.same_content(table(s, d, "comments")),
        "p1_copies": lambda s, d: content.copies(table(s, d, "comments"), table(s, d, "duplicates")),
        "p2_found": lambda s, d: groups.group_members(table(s, d, "near_duplicates")),
        "p2_group_sizes": lambda s, d: groups.linked_groups(table(s, d, "near_duplicates")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_ids")),
        "p3_found": lambda s, d: splits.broken_posts(table(s, d, "split_groups")),
        "p3_splits": lambda s, d: splits.grouped_splits(table(s, d, "comments")),
        "p3_shares": _split_shares,
        "p3_content_splits": _content_splits,
        "p3_checks": _split_checks,
        "p4_found": lambda s, d: consensus.outvoted(table(s, d, "annotations")),
        "p4_consensus": lambda s, d: consensus.discover(table(s, d, "annotations")).items.withColumns({"support": F.round("support", 5), "agreement": F.round("agreement", 9)}),
        "p4_reviewers": lambda s, d: consensus.discover(table(s, d, "annotations")).reviewers.withColumns({c: F.round(c, 5) for c in ("errors", "reliability", "accuracy")}),
        "p6_found": lambda s, d: personal.personal_kinds(table(s, d, "comments")),
        "p6_masked": lambda s, d: personal.masked(table(s, d, "comments")),
        "p7_found": lambda s, d: overlap.split_overlaps(table(s, d, "split_groups"), table(s, d, "comments")).select("id_a", "id_b").distinct(),
        "p7_report": lambda s, d: overlap.overlap_report(table(s, d, "split_groups"), table(s, d, "comments")),
        "p8_found": lambda s, d: leakage.leaked(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id").distinct(),
        "p8_passages": lambda s, d: leakage.leaked(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_clean_documents": _clean_documents,
        "p9_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"), vocabulary=VOCABULARY)[0],
        "p9_checks": lambda s, d: mixing.broken_rules(*mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"), vocabulary=VOCABULARY)),
        "p9_shares": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"), vocabulary=VOCABULARY)[1],
        "p10_found": lambda s, d: lookalike.alike_pairs(table(s, d, "documents")),
        "p10_forms": lambda s, d: lookalike.one_form(table(s, d, "documents")),
    }


def _split_shares(spark, sf_dir):
    """(split, label, n_records, share) of p3_splits."""
    rows = splits.grouped_splits(table(spark, sf_dir, "comments"))
    per = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_records"))
    total = per.agg(F.sum("n_records")).first()[0] or 1
    return per.select("split", "label", "n_records", (F.col("n_records") / F.lit(total)).alias("share"))


def _content_splits(spark, sf_dir):
    """Splits that keep posts and, across posts, equal contents together: two entities a record."""
    post, content = splits.post_key(F.col("post_id")), splits.content_key(F.col("text"))
    return splits.grouped_splits(table(spark, sf_dir, "comments"), keys=[post, content])


def _split_checks(spark, sf_dir):
    """(rule, n_broken) over p3_content_splits: posts and contents in two splits, splits without a label, shares off by more than the balance."""
    comments = table(spark, sf_dir, "comments")
    rows = Workspace(spark, "checks").save(_content_splits(spark, sf_dir))
    keyed = comments.select("id", splits.post_key(F.col("post_id")).alias("post"), splits.content_key(F.col("text")).alias("content")).join(rows.select("id", "split"), "id")
    apart = [keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select(F.lit(f"{k}_in_two_splits").alias("rule")) for k in ("post", "content")]
    held = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"))
    total = F.lit(rows.count())
    want = F.create_map(*[F.lit(x) for kv in splits.SPLITS for x in kv])
    found = apart[0].unionByName(apart[1]).unionByName(held.where(F.col("k") < len(LABELS)).select(F.lit("label_missing").alias("rule")))
    found = found.unionByName(held.where(F.abs(F.col("n") / total - F.try_element_at(want, F.col("split"))) > splits.BALANCE).select(F.lit("share_off").alias("rule")))
    names = spark.createDataFrame([(x,) for x in ("post_in_two_splits", "content_in_two_splits", "label_missing", "share_off")], "rule string")
    return names.join(found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_broken")), "rule", "left").na.fill(0, ["n_broken"])


def _clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, leakage.leaked(docs, table(spark, sf_dir, "eval_items"))).select("doc_id", "source", "n_chars")


_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _words(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[\\p{{P}}{_SPACE}]+', ' ', 'g'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


# Fixed values of the SQL below, written apart from those of the operator: letters of two scripts and the Latin letters of their shape, blanks, and shapeless characters.
_OTHER = "АВЕКМНОРСТХІЅЈаеорсухіѕјһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѐёїЀЁЇόαάρÐƉ"
_LATIN = "ABEKMHOPCTXISJaeopcyxisjhABEZHIKMNOPTYXoèëïÈËÏóaápĐĐ"
_BLANK_CODES = (9, 160, 5760, *range(8192, 8203), 8239, 8287, 12288)
_SHAPELESS_CODES = (173, 847, 1564, 6158, 8203, 8204, 8206, 8207, *range(8234, 8239), *range(8288, 8293), 65279)


def _looks(text: str) -> str:
    """The common form of a text, character by character; joiners stay between pictures."""
    chars = f"regexp_extract_all({text}, '(?s).')"
    picture = lambda i: f"coalesce(unicode(l[{i}]) > 8591 AND unicode(l[{i}]) NOT BETWEEN 65280 AND 65500 AND unicode(l[{i}]) <> 12288, false)"
    one = f"""CASE WHEN unicode(c) = 8205 THEN CASE WHEN {picture("i - 1")} AND {picture("i + 1")} THEN c ELSE '' END
        WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN {_BLANK_CODES} THEN ' ' WHEN unicode(c) IN {_SHAPELESS_CODES} THEN ''
        WHEN strpos('{_OTHER}', c) > 0 THEN substr('{_LATIN}', strpos('{_OTHER}', c), 1) ELSE c END"""
    return f"nfc_normalize(array_to_string(list_transform([{chars}], lambda l : array_to_string(list_transform(l, lambda c, i : {one}), ''))[1:1], ''))"


def _leak_sql(columns: str) -> str:
    form = {t: _words(_looks("text")) for t in ("documents", "eval_items")}
    return f"""
    WITH d AS (SELECT doc_id, string_split({form["documents"]}, ' ') AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT item_id, string_split({form["eval_items"]}, ' ') AS w FROM eval_items),
    dg AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
    eg AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM e)),
    grams AS (SELECT doc_id, item_id, i, j FROM dg JOIN eg USING (g)),
    hit AS (SELECT DISTINCT doc_id, item_id FROM grams)
    {columns}"""


CONSENSUS_ROUNDS = 20  # enough for the tables of the check to settle


def _consensus_sql(columns: str) -> str:
    """The alternation of weights and distances, its rounds written one after the other."""
    label, reviewer = (f"lower({_strip(c)})" for c in ("label", "reviewer"))
    quantiles = ", ".join(f"({n}, {q!r})" for n, q in enumerate(consensus.chi2_quantile(consensus.ALPHA / 2, range(1, 1501)).tolist(), 1))
    parts = [f"""WITH v AS (SELECT id, {reviewer} AS reviewer, {label} AS label, submitted_at FROM annotations WHERE annotation_status = 'human_confirmed'),
        o AS (SELECT *, row_number() OVER (PARTITION BY id, reviewer ORDER BY submitted_at DESC NULLS LAST, label DESC) AS n FROM v WHERE label IN {LABELS} AND reviewer <> '' AND id <> ''),
        l AS MATERIALIZED (SELECT id, reviewer, label, count(*) OVER (PARTITION BY id) AS n FROM o WHERE n = 1),
        q(df, bound) AS (VALUES {quantiles}),
        base AS MATERIALIZED (SELECT reviewer, n_votes, n_judged, bound FROM (SELECT reviewer, count(*) AS n_votes, count(*) FILTER (n > 1) AS n_judged FROM l GROUP BY reviewer) JOIN q ON df = greatest(n_judged, 1)),
        w0 AS (SELECT *, 0.0::DOUBLE AS errors, 1.0::DOUBLE AS weight FROM base)"""]
    sums = ", ".join(f"coalesce(sum(weight) FILTER (label = '{x}'), 0.0) AS s{i}" for i, x in enumerate(LABELS))
    for k in range(CONSENSUS_ROUNDS):
        others = ", ".join(f"round(s{i} - CASE WHEN label = '{x}' THEN weight ELSE 0.0 END, 6) AS r{i}" for i, x in enumerate(LABELS))
        own = " + ".join(f"CASE WHEN label = '{x}' AND r{i} = greatest(r0, r1, r2) THEN 1.0 ELSE 0.0 END" for i, x in enumerate(LABELS))
        ties = " + ".join(f"CASE WHEN r{i} = greatest(r0, r1, r2) THEN 1.0 ELSE 0.0 END" for i in range(3))
        parts.append(f"""t{k} AS MATERIALIZED (SELECT id, {sums} FROM l JOIN w{k} USING (reviewer) GROUP BY id),
        d{k} AS (SELECT reviewer, label, {others} FROM l JOIN w{k} USING (reviewer) JOIN t{k} USING (id)),
        e{k} AS (SELECT reviewer, round(sum(CASE WHEN greatest(r0, r1, r2) > 0 THEN 1 - ({own}) / ({ties}) ELSE 0.0 END), 6) AS errors FROM d{k} GROUP BY reviewer),
        w{k + 1} AS MATERIALIZED (SELECT b.reviewer, n_votes, n_judged, bound, e.errors, bound / (CASE WHEN n_judged > 0 THEN e.errors ELSE 1.0 END + 0.5) AS weight FROM base b JOIN e{k} e USING (reviewer))""")
    return ",\n".join(parts) + columns.replace("WEIGHTS", f"w{CONSENSUS_ROUNDS}").replace("SUMS", sums)


def oracle_sql() -> dict[str, str]:
    entries = f"list_filter(regexp_split_to_array(text, '[;\\n\\r\\x0B\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda e : {_strip('e')} <> '')"
    label, reviewer = (f"lower({_strip(c)})" for c in ("label", "reviewer"))
    post = f"lower({_strip('post_id')})"
    words_of = f"list_distinct(string_split({_words('text')}, ' '))"
    contents = f"""
            WITH c AS (SELECT DISTINCT id, coalesce(text, '') AS text FROM comments WHERE id IS NOT NULL),
            k AS (SELECT id, {_words("text")} AS k1, {entries} AS e FROM c),
            f AS (SELECT id, k1, CASE WHEN len(e) >= 3 AND len(list_filter(e, lambda x : NOT regexp_matches(x, '^[{_SPACE}]*[^:{_SPACE}][^:]*:'))) = 0
                  THEN array_to_string(list_sort(list_transform(e, lambda x : {_words("x")})), chr(10)) END AS k2 FROM k),
            a AS (SELECT *, min(id) OVER (PARTITION BY k1) AS c1 FROM f),
            b AS (SELECT *, CASE WHEN k2 IS NOT NULL THEN min(c1) OVER (PARTITION BY k2) ELSE c1 END AS c2 FROM a),
            r AS (SELECT id, k1, min(c2) OVER (PARTITION BY k1) AS canon FROM b)"""
    linked = f"""
            WITH RECURSIVE p AS (SELECT {_strip("id_a")} AS a, {_strip("id_b")} AS b FROM near_duplicates),
            g AS (SELECT a, b FROM p WHERE a <> '' AND b <> '' AND a <> b),
            e AS (SELECT a AS v, b AS w FROM g UNION SELECT b, a FROM g),
            r AS (SELECT v AS id, v AS root FROM e UNION SELECT e.w, r.root FROM r JOIN e ON e.v = r.id),
            m AS (SELECT id, min(root) AS group_id FROM r GROUP BY id)"""
    near = f"""
            WITH c AS (SELECT DISTINCT id, text FROM comments), s AS (SELECT DISTINCT id, split FROM split_groups),
            w AS (SELECT id, split, {words_of} AS w FROM s JOIN c USING (id) WHERE len(string_split({_words("text")}, ' ')) >= 8),
            j AS (SELECT a.id AS i, b.id AS j, b.split AS split, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS n
                  FROM w a JOIN w b ON a.split = 'train' AND b.split <> 'train' AND 5 * len(a.w) >= 4 * len(b.w) AND 5 * len(b.w) >= 4 * len(a.w)),
            found AS (SELECT DISTINCT i, j, split FROM j WHERE i <> j AND 5 * k >= 4 * (n - k))"""
    zero = lambda *rules: "SELECT * FROM (VALUES " + ", ".join(f"('{r}', 0::BIGINT)" for r in rules) + ") AS t(rule, n_broken)"
    return {
        "p1_found": contents + " SELECT canon AS canonical_id, id AS comment_id FROM r WHERE canon <> id AND len(string_split(k1, ' ')) >= 8",
        "p1_copies": contents + """, n AS (SELECT id, count(*) AS n_rows FROM comments WHERE id IS NOT NULL GROUP BY id),
            g AS (SELECT DISTINCT file_key, row_number, regexp_replace(comment_id, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS id FROM duplicates), h AS (SELECT id, count(*) AS k FROM g GROUP BY id)
            SELECT canon AS canonical_id, count(*) AS n_comments, sum(n_rows)::BIGINT AS n_rows, sum(coalesce(k, 0))::BIGINT AS n_logged, sum(n_rows + coalesce(k, 0))::BIGINT AS n_copies
            FROM r JOIN n USING (id) LEFT JOIN h USING (id) GROUP BY canon""",
        "p2_found": linked + " SELECT group_id, id FROM m WHERE id <> group_id",
        "p2_group_sizes": linked + " SELECT group_id, count(*) AS n_ids FROM m GROUP BY group_id",
        "p3_checks": zero("post_in_two_splits", "content_in_two_splits", "label_missing", "share_off"),
        "p4_consensus": _consensus_sql(""", t AS (SELECT id, count(*) AS n_votes, SUMS FROM l JOIN WEIGHTS USING (reviewer) GROUP BY id),
            c AS (SELECT id, label, count(*) AS k FROM l GROUP BY id, label),
            x AS (SELECT id, label, k, round(CASE label WHEN 'positive' THEN s0 WHEN 'neutral' THEN s1 ELSE s2 END, 6) AS s, CASE label WHEN 'positive' THEN s0 WHEN 'neutral' THEN s1 ELSE s2 END AS raw, list_position(['positive', 'neutral', 'negative'], label) AS p, n_votes, s0 + s1 + s2 AS total FROM t JOIN c USING (id)),
            y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, k DESC, p) AS a, row_number() OVER (PARTITION BY id ORDER BY k DESC, p) AS b, sum(k * (k - 1)) OVER (PARTITION BY id) AS equal FROM x)
            SELECT u.id, u.label AS consensus, round(u.raw / u.total, 5) AS support, u.n_votes, z.label AS top_label, z.k AS top_votes, CASE WHEN u.n_votes > 1 THEN round(u.equal / (u.n_votes * (u.n_votes - 1)), 9) END AS agreement
            FROM y u JOIN y z ON u.id = z.id AND u.a = 1 AND z.b = 1"""),
        "p4_reviewers": _consensus_sql(""" SELECT reviewer, n_votes, round(errors, 5) AS errors, round(weight / (SELECT max(weight) FROM WEIGHTS), 5) AS reliability, CASE WHEN n_judged > 0 THEN round(1 - errors / n_judged, 5) END AS accuracy FROM WEIGHTS"""),
        "p9_checks": zero("shared_slot", "missing_slot", "uneven_block", "gap", "taken_too_often", "over_share"),
        "p3_found": f"""
            SELECT post_id FROM (SELECT {post} AS post_id, split FROM split_groups) WHERE post_id <> '' AND split IS NOT NULL
            GROUP BY post_id HAVING count(DISTINCT split) > 1""",
        "p4_found": f"""
            WITH v AS (SELECT id, {reviewer} AS reviewer, {label} AS label, submitted_at FROM annotations WHERE annotation_status = 'human_confirmed'),
            o AS (SELECT *, row_number() OVER (PARTITION BY id, reviewer ORDER BY submitted_at DESC NULLS LAST, label DESC) AS n FROM v
                  WHERE label IN ('positive', 'neutral', 'negative') AND reviewer <> '' AND id <> ''),
            l AS (SELECT id, reviewer, label FROM o WHERE n = 1),
            t AS (SELECT id, label, count(*) AS k, sum(count(*)) OVER (PARTITION BY id) AS n FROM l GROUP BY id, label)
            SELECT l.id, l.reviewer FROM l JOIN t ON t.id = l.id AND 2 * t.k > t.n AND t.n >= 3 WHERE l.label <> t.label""",
        "p7_found": near + " SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM found",
        "p7_report": near + """, per AS (SELECT j AS id, split, count(DISTINCT i) AS k FROM found GROUP BY ALL), src AS (SELECT id, min(source_id) AS source_id FROM comments GROUP BY id)
            SELECT split, source_id, count(*) AS n_records, sum(k)::BIGINT AS n_pairs FROM per JOIN src USING (id) GROUP BY split, source_id""",
        "p8_passages": _leak_sql(""", island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM grams),
            runs AS (SELECT doc_id, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + 11 AS n_words FROM island GROUP BY doc_id, item_id, i - j, run)
            SELECT doc_id, item_id, n_words::INT AS n_words, doc_word::INT AS doc_word, item_word::INT AS item_word FROM runs
            QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1"""),
        "p8_found": _leak_sql("SELECT doc_id, item_id FROM hit"),
        "p8_clean_documents": _leak_sql("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"),
        "p10_found": f"""
            WITH f AS (SELECT doc_id, text, {_looks("text")} AS form FROM documents)
            SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p10_forms": f"SELECT doc_id, {_looks('text')} AS form FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    }
