"""DuckDB SQL of the core's queries."""

from __future__ import annotations

from quern.labels import LABELS

SPACE = r"\t-\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def text_key(x: str) -> str:
    return collapse(f"lower(nfc_normalize({x}))")


def tokens(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w : w <> '')"


ONE = "one AS (SELECT id, arg_min(struct_pack(p := post_id, t := text, l := label, s := source_id), struct_pack(a := loaded_at, b := source_id, c := collected_at)) AS c FROM comments GROUP BY id)"
LABELLED = f"""{ONE}, labelled AS (SELECT id, c.t AS text, c.l AS label, CASE WHEN lower({strip("coalesce(c.p, '')")}) = '' THEN 'post:' || id ELSE lower({strip("c.p")}) END AS post_id
    FROM one WHERE c.l IN {LABELS})"""
PREDICTED = f"""{LABELLED}, pred AS (SELECT id, post_id, text, label AS t, CASE WHEN regexp_matches(text, '[👎😡😢]') THEN 'negative' WHEN regexp_matches(text, '[👍😊😍]') THEN 'positive' ELSE 'neutral' END AS p FROM labelled)"""
VOTES = f"""v AS (SELECT id, lower({strip("coalesce(reviewer, '')")}) AS reviewer, role, lower({strip("coalesce(label, '')")}) AS label, annotation_status, submitted_at, notes FROM annotations),
    last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, reviewer ORDER BY submitted_at DESC NULLS LAST, role DESC NULLS LAST, label DESC, annotation_status DESC NULLS LAST, notes DESC NULLS LAST) = 1),
    checked AS (SELECT *, coalesce(label IN {LABELS} AND annotation_status = 'human_confirmed' AND reviewer <> '', false) AS ok FROM last)"""
MERGED = f"""{VOTES}, merged AS (SELECT id, count(*) AS n_votes, bool_and(ok) AS complete, bool_and(ok) AND min(label) = max(label) AS unanimous, min(label) AS lo FROM checked GROUP BY id)"""
PAIRS = f"""pairs AS (SELECT DISTINCT least({strip("id_a")}, {strip("id_b")}) AS id_a, greatest({strip("id_a")}, {strip("id_b")}) AS id_b FROM near_duplicates
    WHERE {strip("id_a")} <> '' AND {strip("id_b")} <> '' AND {strip("id_a")} <> {strip("id_b")})"""


def _label_rows() -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") AS l(label)"


PER_LABEL = f"""{PREDICTED}, counts AS (SELECT label, (SELECT count(*) FROM pred WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM pred WHERE t = label) AS nt, (SELECT count(*) FROM pred WHERE p = label) AS np FROM {_label_rows()}),
    prf AS (SELECT label, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS precision, CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS recall, nt AS support FROM counts),
    metrics AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf)"""
FLAGS = {
    "unusual_characters": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]",
    "possible_ui_text": rf"(?i)(?:Xem thêm|See more|Thích[{SPACE}]+Trả lời|Like[{SPACE}]+Reply)",
    "possible_truncation_or_deliberate_ellipsis": rf"(?:\.\.\.|…)[{SPACE}]*$",
    "possible_advertisement_not_automatic_exclusion": r"(?i)(?:tuyển dụng|tuyển sinh|sale|giảm giá|liên hệ|zalo|pass lại|cho thuê)",
    "excel_import_as_text_required": rf"^[{SPACE}]*[=+@-]",
}


def _flag_case(name: str) -> str:
    w = tokens("text")
    if name == "possible_tag_or_name_only_not_automatic_exclusion":
        return f"(len({w}) BETWEEN 2 AND 5 AND len(list_filter({w}, lambda x : NOT regexp_matches(x, '^\\p{{Lu}}\\p{{L}}*$'))) = 0) OR regexp_matches({strip('text')}, '^(?:@[\\p{{L}}\\p{{M}}\\p{{N}}_.]+[{SPACE}]*)+$')"
    return f"regexp_matches(text, '{FLAGS[name]}')"


def _bounded(words: str) -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"(?i)(?:^|{edge})(?:{words})(?:{edge}|$)"


def _slice_union(source: str) -> str:
    n = f"len({tokens('text')})"
    rules = {
        "all": "true", "negation": f"regexp_matches(text, '{_bounded('không|chưa|chẳng|chả|đừng|ko|khum|hok')}')", "emoji": f"regexp_matches(text, '{EMOJI}')",
        "ambiguous_slang": f"regexp_matches(text, '{_bounded('k|dc|đc|mn|sv')}')", "short_1_5_words": f"{n} <= 5", "medium_6_20_words": f"{n} BETWEEN 6 AND 20", "long_over_20_words": f"{n} > 20",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS g, * FROM {source} WHERE {v}" for k, v in rules.items())


# What Java calls a word character, and replacements at word borders without looking around: twice, as two neighbours may share the character between them.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _bordered(x: str, pattern: str, new: str, before: str = WORD, after: str = WORD) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^{before}])(?:{pattern})($|[^{after}])', '\\1{new}\\2', 'g')"
    return x


def basic(x: str) -> str:
    return collapse(f"translate(regexp_replace(nfc_normalize({x}), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{{FFFD}}]', ' ', 'g'), chr(65279) || chr(8203), '')")


def redacted(x: str) -> str:
    x = f"regexp_replace({x}, '[{WORD}.+-]+@[{WORD}.-]+\\.[A-Za-z]{{2,}}', ' emailtoken ', 'g')"
    x = _bordered(x, r"(?:\+84|0)(?:[ .-]?\p{Nd}){9}", " phonetoken ", after=r"\p{Nd}")
    return f"regexp_replace({x}, '(^|[^{WORD}])@[{WORD}.]+', '\\1 usertoken ', 'g')"


def urls(x: str) -> str:
    return f"regexp_replace({x}, '(?i)(?:https?://|www\\.)[^{SPACE}]*?([.,!?;:]*)($|[{SPACE}])', ' urltoken \\1\\2', 'g')"


def slang(x: str) -> str:
    return _bordered(x, "ko|khum|hok", "không")


def normalized(x: str, last: str = "{}") -> str:
    return collapse(last.format(slang(urls(f"lower({redacted(basic(x))})"))))


def mapped_emoji(x: str) -> str:
    for symbol, word in (("😊", " vui "), ("😍", " yêu thích "), ("👍", " tán thành "), ("😢", " buồn "), ("😡", " tức giận "), ("👎", " không thích ")):
        x = f"replace({x}, '{symbol}', '{word}')"
    return x


def preview(x: str) -> str:
    x = f"regexp_replace({x}, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', '[URL]', 'g')"
    x = f"regexp_replace({x}, '[{WORD}.+-]+@[{WORD}.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g')"
    x = _bordered(x, r"(?:\+?84|0)[\p{Nd} .-]{8,14}\p{Nd}", "[SỐ LIÊN HỆ]")
    x = f"regexp_replace({x}, '@[{WORD}.]+', '[TAG]', 'g')"
    x = f"regexp_replace({x}, '(?i)(?:Người tham gia ẩn danh|Anonymous participant)[{SPACE}]*\\p{{Nd}}+', '[NGƯỜI ĐƯỢC NHẮC]', 'g')"
    return _bordered(x, r"[A-Za-z][A-Za-z_]*\p{Nd}{3,}", "[NGƯỜI ĐƯỢC NHẮC]")


def _parsed() -> str:
    """The raw records cut by one regular expression a field, with the first reason that holds."""
    field, end = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)', "(?:\\r?\\n|\\r)?"
    value = lambda n: f"""CASE WHEN starts_with(f[{n}], '"') THEN replace(substr(f[{n}], 2, length(f[{n}]) - 2), '""', '"') ELSE f[{n}] END"""
    names = ("id", "post_id", "text", "label", "collected_at")
    day = "coalesce(try_cast(regexp_extract(collected_at, '^(\\d{4}-\\d\\d-\\d\\d)T', 1) AS DATE), try_cast(regexp_replace(regexp_extract(collected_at, '^(\\d{8})T', 1), '(....)(..)(..)', '\\1-\\2-\\3') AS DATE)) IS NOT NULL"
    clock = "regexp_matches(collected_at, 'T(?:(?:[01]\\d|2[0-3])(?::?[0-5]\\d(?::?(?:[0-5]\\d|60)(?:[.,]\\d+)?)?)?|24(?::?00(?::?00)?)?)(?:Z|[+-](?:[01]\\d|2[0-3])(?::?[0-5]\\d)?)?$')"
    return f"""r AS (SELECT file_key, row_number, coalesce(raw, '') AS raw FROM raw_rows),
        c AS (SELECT *, regexp_full_match(raw, '(?s){field}(?:,{field})*{end}') AS quoted, length(regexp_replace(regexp_replace(raw, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) + 1 AS n FROM r),
        s AS (SELECT *, CASE WHEN quoted AND n = 5 THEN [{", ".join(f"regexp_extract(raw, '(?s)^({field}),({field}),({field}),({field}),({field}){end}$', {k})" for k in range(1, 6))}] END AS f FROM c),
        v AS (SELECT file_key, row_number, quoted, n, {", ".join(f"{value(k)} AS {name}" for k, name in enumerate(names, 1))} FROM s),
        parsed AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 5 THEN 'column_count'
            WHEN id = '' OR post_id = '' OR {strip("id")} <> id OR {strip("post_id")} <> post_id OR {strip("text")} = '' OR contains(text, '�') OR label NOT IN ('', 'positive', 'neutral', 'negative') OR NOT ({day} AND {clock}) THEN 'invalid_value' END AS reason FROM v)"""


def _bayes(name: str, held: str, alpha: float, grams: int = 1) -> str:
    """Predictions (id, t, p) of naive Bayes from counts, as the table ``name``; rows has id, label, split and w, the tokens."""
    own = f"list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))" if grams == 2 else "w"
    return f"""{name}_g AS MATERIALIZED (SELECT id, label, split, unnest({own}) AS term FROM rows),
        {name}_v AS (SELECT term FROM {name}_g WHERE split = 'train' GROUP BY term ORDER BY count(*) DESC, term LIMIT 20000),
        {name}_c AS (SELECT label, term, count(*) AS s FROM {name}_g JOIN {name}_v USING (term) WHERE split = 'train' GROUP BY label, term),
        {name}_n AS (SELECT label, sum(s) + {alpha} * (SELECT count(*) FROM {name}_v) AS norm FROM {name}_c GROUP BY label),
        {name}_p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows WHERE split = 'train')) AS prior FROM rows WHERE split = 'train' GROUP BY label),
        {name}_t AS (SELECT id, term, count(*) AS tf FROM {name}_g JOIN {name}_v USING (term) WHERE {held} GROUP BY id, term),
        {name}_s AS (SELECT h.id, h.label AS t, p.label AS p, any_value(p.prior) + coalesce(sum(x.tf * ln((coalesce(c.s, 0) + {alpha}) / n.norm)), 0) AS score
            FROM (SELECT id, label FROM rows WHERE {held}) h CROSS JOIN {name}_p p JOIN {name}_n n ON n.label = p.label LEFT JOIN {name}_t x ON x.id = h.id LEFT JOIN {name}_c c ON c.label = p.label AND c.term = x.term GROUP BY h.id, h.label, p.label),
        {name} AS (SELECT id, t, p FROM {name}_s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, p) = 1)"""


def _macro_of(name: str) -> str:
    return f"""(SELECT avg(CASE WHEN tp > 0 THEN 2 * tp / (nt + np) ELSE 0.0 END) FROM (SELECT (SELECT count(*) FROM {name} WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM {name} WHERE t = label) AS nt,
        (SELECT count(*) FROM {name} WHERE p = label) AS np FROM {_label_rows()}))"""


INGEST_ROUNDS = 10  # enough for the tables of the check


def _ingest() -> str:
    """Rounds of acceptance written one after the other: the first of its id and of its key is in, what shares either with it is out."""
    blank = " OR ".join(f"coalesce({strip(c)}, '') = ''" for c in ("id", "post_id", "text"))
    parts = [f"""WITH numbered AS (SELECT row_number() OVER (ORDER BY loaded_at, id) AS seq, coalesce(id, '') AS id, coalesce(post_id, '') AS post_id, coalesce(text, '') AS text FROM comments),
        s AS MATERIALIZED (SELECT seq, id, post_id, text, {text_key("text")} AS k, CASE WHEN {blank} THEN 'missing_field' WHEN {strip("id")} <> id OR {strip("post_id")} <> post_id THEN 'edge_space' END AS why FROM numbered),
        n0 AS MATERIALIZED (SELECT min(seq) AS seq, id, k FROM s WHERE why IS NULL GROUP BY id, k)"""]
    for r in range(INGEST_ROUNDS):
        parts.append(f"""w{r} AS MATERIALIZED (SELECT * FROM n{r} QUALIFY seq = min(seq) OVER (PARTITION BY id) AND seq = min(seq) OVER (PARTITION BY k)),
        n{r + 1} AS MATERIALIZED (SELECT * FROM n{r} WHERE id NOT IN (SELECT id FROM w{r}) AND k NOT IN (SELECT k FROM w{r}))""")
    taken = " UNION ALL ".join(f"SELECT * FROM w{r}" for r in range(INGEST_ROUNDS))
    return ",\n".join(parts) + f""", a AS (SELECT a.seq, a.id, s.post_id, s.text FROM ({taken}) a JOIN s USING (seq)),
        j AS (SELECT s.seq, s.id, s.why, a.seq AS first, (a.post_id, a.text) <> (s.post_id, s.text) AS other FROM s LEFT JOIN a ON a.id = s.id)
        SELECT seq, id, CASE WHEN why IS NOT NULL THEN 'rejected' WHEN first = seq THEN 'accepted' WHEN first < seq AND other THEN 'rejected' ELSE 'duplicate' END AS state,
        CASE WHEN why IS NOT NULL THEN why WHEN first < seq AND other THEN 'conflicting_id' END AS reason FROM j"""


def _zero(*rules: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{r}', 0::BIGINT)" for r in rules) + ") AS t(rule, n_broken)"


def oracles() -> dict[str, str]:
    key = f"sha256({text_key('text')})"
    blank = lambda c: f"coalesce({strip(c)}, '') = ''"
    numbered = "numbered AS (SELECT *, row_number() OVER (ORDER BY loaded_at, id) AS seq FROM comments)"
    grams = lambda n: f"SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i : array_to_string(w[i : i + {n - 1}], ' '))) AS term FROM w"
    w_of = f"{LABELLED}, w AS (SELECT id, {tokens('text')} AS w FROM labelled)"
    out = {
        "exact_duplicate_groups": f"SELECT {key} AS group_key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM comments GROUP BY 1 HAVING count(*) > 1",
        "first_canonical": f"""WITH {numbered}, k AS (SELECT id, seq, {key} AS k FROM numbered)
            SELECT id, first(id) OVER (PARTITION BY k ORDER BY seq) AS canonical_id FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1""",
        "duplicate_id_rows": "SELECT id, epoch_us(loaded_at) AS loaded_us FROM comments QUALIFY count(*) OVER (PARTITION BY id) > 1",
        "violations": f"""WITH r AS (SELECT unnest(list_filter([
                {", ".join(f"CASE WHEN {blank(c)} THEN 'blank_{c}' END" for c in ("id", "post_id", "text", "label"))},
                CASE WHEN contains(text, '�') THEN 'replacement_character' END,
                {", ".join(f"CASE WHEN {strip(c)} <> {c} THEN 'edge_space_{c}' END" for c in ("id", "post_id"))},
                CASE WHEN label NOT IN {LABELS} THEN 'unknown_label' END], lambda x : x IS NOT NULL)) AS rule FROM comments
            UNION ALL SELECT 'duplicate_id' FROM comments QUALIFY count(*) OVER (PARTITION BY id) > 1
            UNION ALL SELECT 'duplicate_text' FROM comments QUALIFY count(*) OVER (PARTITION BY {text_key("text")}) > 1)
            SELECT rule, count(*) AS n FROM r GROUP BY rule""",
        "label_statistics": f"SELECT count(*) AS rows, count(DISTINCT post_id) AS posts, {', '.join(f'count(*) FILTER (label = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in LABELS)} FROM comments",
        "label_by_post": f"SELECT post_id, {', '.join(f'count(*) FILTER (label = {chr(39)}{x}{chr(39)}) AS {x}' for x in LABELS)} FROM comments GROUP BY post_id",
        "comment_profile": f"""SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS duplicate_id_rows, count(DISTINCT post_id) FILTER (NOT {blank("post_id")}) AS posts,
            {", ".join(f"count(*) FILTER ({blank(c)}) AS missing_{c}" for c in ("id", "post_id", "text", "source_id", "source_url"))}, min(collected_at) AS first_collected, max(collected_at) AS last_collected FROM comments""",
        "source_counts": "SELECT source_id AS value, count(*) AS n FROM comments GROUP BY source_id",
        "quality_flag_counts": "SELECT flag, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS flag FROM comments WHERE {_flag_case(f)}" for f in [*FLAGS, "possible_tag_or_name_only_not_automatic_exclusion"]) + ") GROUP BY flag",
        "split_file_profile": f"""WITH m AS (SELECT count(*) AS rows, count(DISTINCT post_id) AS posts, count(text) - count(DISTINCT text) AS repeated_texts,
            {", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("id", "post_id", "text", "label"))}, {", ".join(f"count(*) FILTER (lower({strip('label')}) = '{x}') AS label_{x}" for x in LABELS)},
            count(*) FILTER (label IS NULL OR lower({strip("label")}) NOT IN {LABELS}) AS label_other FROM comments)
            UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value""",
        "audit": f"""WITH {numbered}, b AS (SELECT seq, coalesce(id, '') AS oid, coalesce(post_id, '') AS post, coalesce(text, '') AS text, {strip("coalesce(id, '')")} = '' AS no_id FROM numbered),
            l AS (SELECT *, lag(struct_pack(p := post, t := text)) OVER (PARTITION BY oid ORDER BY seq) AS before FROM b),
            m AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN before = struct_pack(p := post, t := text) THEN 'duplicate_id' ELSE 'conflicting_id' END AS rep FROM l),
            r AS (SELECT *, list_filter([CASE WHEN {strip("text")} = '' THEN 'empty_text' END, CASE WHEN {strip("oid")} <> oid OR {strip("post")} <> post THEN 'identifier_whitespace_requires_source_correction' END, rep,
                CASE WHEN regexp_matches({strip("text")}, '^(?:https?://[^{SPACE}]+[{SPACE}]*)+$') THEN 'url_only' END,
                CASE WHEN {strip("text")} <> '' AND regexp_matches(text, '^[{SPACE}.,…!?_\\-]+$') THEN 'punctuation_only_no_sentiment_evidence' END], lambda x : x IS NOT NULL) AS reasons,
                bool_or(coalesce(rep = 'conflicting_id', false)) OVER (PARTITION BY oid) AS conflict FROM m)
            SELECT seq, CASE WHEN no_id THEN 'internal_missing_source_id' ELSE 'source' END AS id_origin,
                array_to_string(list_filter([{", ".join(f"CASE WHEN {_flag_case(f)} THEN '{f}' END" for f in [*list(FLAGS)[:4], "possible_tag_or_name_only_not_automatic_exclusion", "excel_import_as_text_required"])}], lambda x : x IS NOT NULL), ';') AS audit_flags,
                CASE WHEN len(reasons) = 0 AND conflict THEN 'conflicting_id' ELSE array_to_string(reasons, ';') END AS reasons FROM r""",
        "row_hashes": "SELECT id, epoch_us(loaded_at) AS loaded_us, sha256(array_to_string(list_transform([id, post_id, text, label], lambda x : coalesce('=' || x, '!')), chr(1))) AS row_sha256 FROM comments",
        "text_keys": f"SELECT id, epoch_us(loaded_at) AS loaded_us, {text_key('text')} AS text_key FROM comments",
        "basic_normalized": f"""SELECT id, epoch_us(loaded_at) AS loaded_us, {collapse("translate(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{FFFD}]', ' ', 'g'), chr(65279) || chr(8203), '')")} AS text FROM comments""",
        "_removed": "SELECT id, epoch_us(loaded_at) AS loaded_us, regexp_replace(text, '[\\p{L}\\p{M}\\p{N}_.+-]+@[\\p{L}\\p{M}\\p{N}_.-]+\\.[A-Za-z]{2,}', ' emailtoken ', 'g') AS text FROM comments",
        "word_counts": f"SELECT id, epoch_us(loaded_at) AS loaded_us, len({tokens('text')}) AS n_words FROM comments",
        "text_slices": f"SELECT g AS slice, count(*) AS n FROM ({_slice_union('comments')}) GROUP BY g",
        "bow_top_terms": f"WITH {w_of}, c AS (SELECT id, unnest(w) AS term FROM w) SELECT term, count(DISTINCT id) AS df, count(*) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 100",
        "bigram_counts": f"WITH {w_of}, g AS ({grams(2)}) SELECT term, count(*) AS total FROM g GROUP BY term",
        "trigram_total": f"WITH {w_of} SELECT sum(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_grams FROM w",
        "char_ngram_total": f"WITH {w_of}, c AS (SELECT length(unnest(w)) + 2 AS n FROM w) SELECT sum(CASE WHEN n <= 3 THEN 1 WHEN n = 4 THEN 2 + 1 WHEN n = 5 THEN 3 + 2 + 1 ELSE n - 2 + n - 3 + n - 4 END)::BIGINT AS n_grams FROM c",
        "tfidf": f"""WITH {w_of}, c AS (SELECT id, unnest(w) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM c GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
            v AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term))
            SELECT id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM v""",
        "nb_priors": f"WITH {LABELLED}, tr AS (SELECT label FROM labelled JOIN split_groups g USING (id) WHERE g.split = 'train') SELECT label, count(*) AS n, round(ln(count(*) / (SELECT count(*) FROM tr)), 9) AS log_prior FROM tr GROUP BY label",
        "majority_predictions": f"WITH {LABELLED}, top AS (SELECT label FROM labelled GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT top.label AS predicted_label, (SELECT count(*) FROM labelled) AS n FROM top",
        "truncation": f"WITH n AS (SELECT len({tokens('text')}) + 2 AS n FROM comments) SELECT count(*) FILTER (n > 64) AS n_truncated, max(n) AS longest, avg((n > 64)::INT) AS truncated_share FROM n",
        "confusion_matrix": f"WITH {PREDICTED} SELECT label AS true_label, {', '.join(f'(SELECT count(*) FROM pred WHERE t = label AND p = {chr(39)}{x}{chr(39)}) AS {x}' for x in LABELS)} FROM {_label_rows()}",
        "label_metrics": f"WITH {PER_LABEL} SELECT label, precision, recall, f1, support FROM metrics",
        "macro_metrics": f"WITH {PER_LABEL} SELECT (SELECT count(*) FROM pred) AS n_samples, (SELECT avg((t = p)::INT) FROM pred) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM metrics",
        "slice_metrics": f"""WITH {PREDICTED}, s AS ({_slice_union("pred")}), c AS (SELECT g, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS nt, count(*) FILTER (p = label) AS np FROM s, {_label_rows()} GROUP BY g, label),
            f AS (SELECT g, avg(CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) ELSE 0.0 END) AS macro_f1 FROM c GROUP BY g)
            SELECT s.g AS "group", count(*) AS support, avg((t = p)::INT) AS accuracy, any_value(f.macro_f1) AS macro_f1, count(*) FILTER (t <> p) AS errors FROM s JOIN f USING (g) GROUP BY s.g""",
        "errors_by_post": f"WITH {PREDICTED} SELECT post_id, count(*) AS support, count(*) FILTER (t <> p) AS errors FROM pred GROUP BY post_id",
        "misclassified": f"WITH {PREDICTED} SELECT id, t AS true_label, p AS predicted_label FROM pred WHERE t <> p",
        "vote_agreement": f"""WITH {VOTES}, o AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY role <> 'primary', reviewer, label) AS r, count(*) OVER (PARTITION BY id) AS n FROM checked WHERE ok),
            p AS (SELECT id, max(label) FILTER (r = 1) AS a, max(label) FILTER (r = 2) AS b FROM o WHERE n = 2 GROUP BY id),
            s AS (SELECT count(*) AS n_pairs, avg((a = b)::INT) AS agreement, {" + ".join(f"avg((a = '{x}')::INT) * avg((b = '{x}')::INT)" for x in LABELS)} AS chance FROM p)
            SELECT n_pairs, agreement, CASE WHEN chance < 1 THEN (agreement - chance) / (1 - chance) END AS kappa FROM s""",
        "merged_votes": f"""WITH {MERGED} SELECT id, n_votes, complete, unanimous, CASE WHEN unanimous THEN lo END AS label,
            CASE WHEN unanimous THEN NULL WHEN complete THEN 'disagreement' ELSE 'missing_invalid_or_unconfirmed' END AS issue_reason FROM merged""",
        "unanimity": f"WITH {MERGED} SELECT count(*) AS n_complete, avg(unanimous::INT) AS unanimous_share FROM merged WHERE complete AND n_votes > 1",
        "split_leaks": f"""WITH {ONE}, r AS (SELECT g.id, g.split, c.p AS post_id, {key.replace("text", "c.t")} AS k FROM split_groups g JOIN one USING (id)),
            x AS (SELECT split, 'id' AS kind, id AS value FROM r UNION SELECT split, 'post_id', post_id FROM r UNION SELECT split, 'text', k FROM r)
            SELECT kind, value, count(DISTINCT split) AS n_splits FROM x WHERE value IS NOT NULL GROUP BY kind, value HAVING count(DISTINCT split) > 1""",
        "crossing_pairs": f"WITH {PAIRS} SELECT id_a, id_b, a.split AS split_a, b.split AS split_b FROM pairs JOIN split_groups a ON a.id = id_a JOIN split_groups b ON b.id = id_b WHERE a.split <> b.split",
        "broken_components": "SELECT split_component, count(DISTINCT split) AS n_splits FROM split_groups GROUP BY split_component HAVING count(DISTINCT split) > 1",
        "post_components": f"""WITH RECURSIVE {LABELLED}, {PAIRS}, posts AS (SELECT id, CASE WHEN lower({strip("coalesce(c.p, '')")}) <> '' THEN lower({strip("c.p")}) WHEN c.l IN {LABELS} THEN 'post:' || id ELSE '' END AS post FROM one),
            e AS (SELECT a.post AS v, b.post AS w FROM pairs JOIN posts a ON a.id = id_a JOIN posts b ON b.id = id_b WHERE a.post <> '' AND b.post <> ''),
            both_ways AS (SELECT v, w FROM e UNION SELECT w, v FROM e UNION SELECT post_id, post_id FROM labelled),
            reach(id, root) AS (SELECT v, v FROM both_ways UNION SELECT b.w, r.root FROM reach r JOIN both_ways b ON b.v = r.id)
            SELECT id AS post_id, 'split_component_' || substr(sha256(min(root)), 1, 16) AS split_component FROM reach WHERE id IN (SELECT post_id FROM labelled) GROUP BY id""",
        # candidates share one of their rarest tokens, which loses no pair of this similarity
        "jaccard_pairs": f"""WITH {ONE}, k AS (SELECT id, {text_key("c.t")} AS key FROM one), r AS (SELECT min(id) AS id, key, list_distinct(string_split(key, ' ')) AS w FROM k WHERE length(key) >= 12 GROUP BY key),
            t AS (SELECT id, len(w) AS n, unnest(w) AS token FROM r), f AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM t),
            p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, token) <= n - ceil(n * 3 / 5) + 1),
            cand AS (SELECT DISTINCT a.id AS i, b.id AS j FROM p a JOIN p b ON a.token = b.token AND a.id < b.id),
            x AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS n FROM cand JOIN r a ON a.id = i JOIN r b ON b.id = j
                  WHERE least(length(a.key), length(b.key)) >= 0.8 * greatest(length(a.key), length(b.key)))
            SELECT id_a, id_b, round(c / (n - c), 9) AS jaccard FROM x WHERE 5 * c >= 3 * (n - c)""",
    }
    del out["_removed"]
    arrived = "SELECT id, epoch_us(loaded_at) AS loaded_us, "
    texts = {"normalized_texts": normalized("text"), "normalized_emoji_mapped": normalized("text", mapped_emoji("{}")), "redacted_texts": redacted("text"), "replaced_urls": urls("text"), "expanded_slang": slang("lower(text)")}
    out |= {name: f"{arrived}{x} AS text FROM comments" for name, x in texts.items()}
    out["stopped_texts"] = f"{arrived}array_to_string(list_filter({tokens(normalized('coalesce(text, chr(0))'))}, lambda w : w NOT IN ('là', 'thì', 'mà')), ' ') AS text FROM comments"
    out["redacted_previews"] = f"""WITH m AS (SELECT row_number() OVER () AS n, id, epoch_us(loaded_at) AS loaded_us, text IS NULL AS missing, {tokens(preview("text"))} AS w FROM comments),
        u AS (SELECT n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM m), g AS (SELECT *, regexp_matches(x, '^\\p{{Lu}}') AND x <> upper(x) AS named FROM u),
        h AS (SELECT *, i - row_number() OVER (PARTITION BY n, named ORDER BY i) AS run FROM g),
        k AS (SELECT n, min(i) AS i, CASE WHEN named AND count(*) > 1 THEN '[TÊN/CỤM VIẾT HOA]' ELSE string_agg(x, ' ' ORDER BY i) END AS x FROM h GROUP BY n, named, run),
        t AS (SELECT n, string_agg(x, ' ' ORDER BY i) AS text FROM k GROUP BY n)
        SELECT id, loaded_us, CASE WHEN NOT missing THEN coalesce(text, '') END AS text FROM m LEFT JOIN t USING (n)"""
    modelled = f"{LABELLED}, rows AS MATERIALIZED (SELECT id, label, split, {tokens(normalized('text'))} AS w FROM labelled JOIN split_groups g USING (id))"
    out["nb_predictions"] = f"WITH {modelled}, {_bayes('b', chr(39).join(['split <> ', 'train', '']), 0.5)} SELECT id, t AS true_label, p AS predicted_label FROM b"
    out["nb_macro_metrics"] = f"""WITH {modelled}, {_bayes('b', "split <> 'train'", 0.5)}, c AS (SELECT (SELECT count(*) FROM b WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM b WHERE t = label) AS nt, (SELECT count(*) FROM b WHERE p = label) AS np FROM {_label_rows()}),
        m AS (SELECT CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS precision, CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS recall FROM c)
        SELECT (SELECT count(*) FROM b) AS n_samples, (SELECT avg((t = p)::INT) FROM b) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END) AS macro_f1 FROM m"""
    grid = [(1, 0.5), (1, 1.0), (2, 0.5), (2, 1.0)]
    out["grid_log"] = f"""WITH {modelled}, {", ".join(_bayes(f"b{n}", "split = 'validation'", a, g) for n, (g, a) in enumerate(grid))},
        l AS (SELECT * FROM (VALUES {", ".join(f"({n}::INT, '1-{g}', {a}::DOUBLE, round({_macro_of(f'b{n}')}, 9))" for n, (g, a) in enumerate(grid))}) AS t(candidate, ngram, param, validation_macro_f1))
        SELECT *, row_number() OVER (ORDER BY validation_macro_f1 DESC, candidate) = 1 AS best FROM l"""
    out["feature_profile"] = f"""WITH {modelled}, v AS (SELECT term FROM (SELECT unnest(w) AS term FROM rows WHERE split = 'train') GROUP BY term ORDER BY count(*) DESC, term LIMIT 20000),
        h AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(w) AS term FROM rows WHERE split <> 'train') JOIN v USING (term))
        SELECT (SELECT count(*) FROM rows WHERE split <> 'train') AS n_rows, count(DISTINCT term) AS n_terms, count(*) AS stored, (SELECT count(*) FROM rows WHERE split <> 'train') - count(DISTINCT id) AS zero_rows FROM h"""
    out["word_char_vocabulary"] = f"""WITH {modelled}, w AS (SELECT DISTINCT unnest(w) AS w FROM rows WHERE split = 'train'), p AS (SELECT ' ' || w || ' ' AS p FROM w),
        c AS (SELECT DISTINCT unnest(flatten(list_transform([3, 4, 5], lambda n : CASE WHEN length(p) <= n THEN [p] ELSE list_transform(range(1, length(p) - n + 2), lambda i : substr(p, i, n)) END))) AS g FROM p)
        SELECT 'word' AS part, least(count(*), 20000) AS n_terms FROM w UNION ALL SELECT 'char', least(count(*), 20000) FROM c"""
    out["classification_report"] = f"WITH {PER_LABEL} SELECT label, precision, recall, f1, support FROM metrics UNION ALL SELECT 'macro_avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM metrics"
    out["ingest_states"] = _ingest()
    out["p5_found"] = f"WITH {_parsed()} SELECT DISTINCT file_key, row_number, reason FROM parsed WHERE reason IS NOT NULL"
    out["p5_loaded"] = f"WITH {_parsed()} SELECT id, post_id, text, label, collected_at, file_key, row_number FROM parsed WHERE reason IS NULL"
    out["p5_reasons"] = f"WITH {_parsed()}, d AS (SELECT DISTINCT file_key, row_number, reason FROM parsed WHERE reason IS NOT NULL) SELECT file_key, reason, count(*) AS n FROM d GROUP BY file_key, reason"
    out["grouped_split_checks"] = _zero("post_in_two_splits", "label_missing", "share_off")
    out["assignment_checks"] = _zero("one_primary", "person_twice", "uneven", "without_task", "odd_number")
    flagged = out["audit"].rpartition("SELECT seq,")[0]
    ends = f"{PAIRS}, ends AS (SELECT id_a AS id FROM pairs UNION SELECT id_b FROM pairs)"
    listed = out["audit"].rpartition("SELECT seq,")[2].rpartition("FROM r")[0]
    out["audit_report"] = f"""{flagged.rstrip()}, {ends}, z AS (SELECT oid, {listed} FROM r),
        y AS (SELECT list_concat([{{'kind': 'rows', 'value': 'all'}}, {{'kind': 'rows', 'value': CASE WHEN reasons = '' THEN 'clean' ELSE 'excluded' END}}],
            list_transform(list_filter(string_split(audit_flags, ';') || CASE WHEN oid IN (SELECT id FROM ends) THEN ['near_duplicate_candidate'] ELSE []::VARCHAR[] END, lambda x : x <> ''), lambda x : {{'kind': 'flag', 'value': x}}),
            list_transform(list_filter(string_split(reasons, ';'), lambda x : x <> ''), lambda x : {{'kind': 'reason', 'value': x}})) AS l FROM z),
        e AS (SELECT unnest(l) AS e FROM y) SELECT e.kind AS kind, e.value AS value, count(*) AS n FROM e GROUP BY ALL"""
    out["capture_relationships"] = f"""WITH {ONE}, rows AS (SELECT id, coalesce(post_id, '') AS p, coalesce(text, '') AS t FROM comments), main AS (SELECT id, coalesce(c.p, '') AS p, coalesce(c.t, '') AS t, {text_key("coalesce(c.t, '')")} AS k FROM one WHERE c.l IN {LABELS}),
        keys AS (SELECT k, max(id) AS by_text FROM main GROUP BY k),
        j AS (SELECT CASE WHEN m.id IS NOT NULL THEN CASE WHEN (m.p, m.t) = (r.p, r.t) THEN 'same_id' ELSE 'conflicting_id' END WHEN by_text IS NOT NULL THEN 'historical_content' ELSE 'new_content' END AS relationship, coalesce(m.id, by_text) AS canonical
            FROM (SELECT *, {text_key("t")} AS k FROM rows) r LEFT JOIN main m ON m.id = r.id LEFT JOIN keys ON keys.k = r.k)
        SELECT relationship, count(*) AS n, count(DISTINCT canonical) AS n_canonical FROM j GROUP BY relationship"""
    flag_list = ", ".join(f"CASE WHEN {_flag_case(f).replace('text', 'c.t')} THEN '{f}' END" for f in [*FLAGS, "possible_tag_or_name_only_not_automatic_exclusion"])
    decided = f"""WITH {ONE}, base AS (SELECT row_number() OVER (ORDER BY id) AS seq, id, coalesce({strip("coalesce(c.p, '')")}, '') <> '' AS done, coalesce(c.t, '') AS t, coalesce(c.l IN {LABELS} AND {strip("coalesce(c.s, '')")} <> '', false) AS human, c.l AS l,
            array_to_string(list_sort(list_filter([{flag_list}], lambda x : x IS NOT NULL)), ';') AS audit_flags FROM one),
        d AS (SELECT *, CASE WHEN NOT done THEN '' WHEN regexp_matches(t, '[👎😡😢]') THEN 'negative' WHEN regexp_matches(t, '[👍😊😍]') THEN 'positive' WHEN length(t) > 200 THEN 'neutral' ELSE '' END AS s,
            done AND regexp_matches({strip("t")}, '^(?:https?://[^{SPACE}]+[{SPACE}]*)+$') AS gone FROM base),
        s AS (SELECT id, s AS suggested_label, CASE WHEN NOT done OR s = '' THEN 'high' ELSE 'low' END AS review_priority, CASE WHEN human THEN l ELSE '' END AS label, CASE WHEN human THEN 'human_confirmed' ELSE 'pending_review' END AS annotation_status,
            CASE WHEN done THEN 'yes' ELSE 'no' END AS ai_processed, audit_flags, CASE WHEN human THEN 'explicit_human_confirmation_in_input' ELSE '' END AS label_source FROM d WHERE NOT gone)"""
    out["review_suggestions"] = f"{decided} SELECT * FROM s"
    out["review_required"] = f"{decided} SELECT * FROM s WHERE review_priority = 'high'"
    out["review_unprocessed"] = f"{decided} SELECT * FROM s WHERE ai_processed = 'no'"
    out["review_excluded"] = f"{decided} SELECT id, 'rule' AS exclusion_reason, 'language_review' AS exclusion_stage FROM d WHERE gone"
    out["review_view"] = f"{decided} SELECT seq, id FROM d WHERE NOT done AND seq BETWEEN 1 AND 1000"
    counted = {
        "valid_rows": "true", "processed_kept_rows": "ai_processed = 'yes'", "remaining_rows": "ai_processed = 'no'", "suggested_rows": "suggested_label <> ''", "processed_without_suggestion": "ai_processed = 'yes' AND suggested_label = ''",
        "review_required_rows": "review_priority = 'high'", "high_priority_processed_rows": "ai_processed = 'yes' AND review_priority = 'high'", "human_confirmed_rows": "annotation_status = 'human_confirmed'",
    } | {f"suggested_{x}": f"suggested_label = '{x}'" for x in LABELS} | {f"human_{x}": f"label = '{x}'" for x in LABELS}
    out["review_progress"] = decided + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({v}) AS value FROM s" for k, v in counted.items())
    out["release_report"] = f"""WITH {MERGED}, o AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY role <> 'primary', reviewer, label) AS r, count(*) OVER (PARTITION BY id) AS n FROM checked WHERE ok),
        p AS (SELECT id, max(label) FILTER (r = 1) = max(label) FILTER (r = 2) AS same FROM o WHERE n = 2 GROUP BY id),
        x AS (SELECT count(*) AS done, round(avg(same::INT), 9) AS agreement FROM p)
        SELECT CASE WHEN q OR u > 0 THEN 'needs_human_review' ELSE 'confirmed' END AS status, u AS unresolved_samples, done AS cross_samples_completed, agreement AS cross_agreement, q AS quality_review_required
        FROM (SELECT *, coalesce(done <> 0 OR agreement < 0.8, true) AS q, (SELECT count(*) FROM merged WHERE NOT unanimous) AS u FROM x)"""
    return out
