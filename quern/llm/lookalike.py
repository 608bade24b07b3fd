"""Problem 10: one form for texts that look alike.

The rewriting is SQL that DuckDB runs over the Arrow batches inside Spark's tasks: a translate for
full-width forms, blanks, look-alike letters and invisible characters, regular expressions that
keep the joiners of emoji sequences, and nfc_normalize for accents. Compatibility forms and
letters with marks come from the Unicode character data by rule; only shapes that two scripts
share are a table. Case, accents, raised figures, emoji and line breaks are left alone, and so
are all characters that are in no rule (private use ones among them).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.workspace import Workspace

# Letters that have the shape of a Latin letter, script by script, each with that letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ν": "v",
    # Armenian, Coptic
    "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N",
    # Latin
    "Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g", "ᴏ": "o", "ꞌ": "'", "ǃ": "!", "ː": ":",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # signs
    "‐": "-", "‑": "-", "⁄": "/", "∕": "/", "։": ":", "׃": ":", "∶": ":", "․": ".", "\u037e": ";",
}
# Blanks that are no line breaks, and characters without any shape (the joiner, variation selectors and tags follow rules of their own).
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
)
JOINER = "\u200d"
PICTURES = "\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2190}-\\x{21FF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{E0020}-\\x{E007F}"
SELECTORS, TAGS = "\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}", "\\x{E0001}\\x{E0020}-\\x{E007F}"
# Kinds of compatibility forms that keep the shape; raised, lowered, encircled and fraction forms don't.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<compat>")


@cache
def shapes() -> dict[str, str]:
    """Every character that another text looks like, with that text.

    Besides the look-alikes these are the compatibility forms of letters, numbers and full-width
    signs, and the letters with marks of which the base is one of these.
    """
    own = dict(LOOKALIKES)
    for c in range(0x80, 0x20000):
        ch = chr(c)
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        if kind not in SAME_SHAPE or ch in "\u017f" or ch in BLANKS or ch in INVISIBLE or 0x3130 <= c < 0x3190:
            continue
        target = "".join(chr(int(x, 16)) for x in parts.split())
        letters = all(unicodedata.category(x)[0] in "LNM" for x in target) and unicodedata.category(ch)[0] in "LN"
        if kind in ("<wide>", "<narrow>") or letters:
            own[ch] = target
    out = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if 0xAC00 <= c < 0xD7A4:
            continue
        target, seen = ch, 0
        while seen < 4:  # forms of forms, and forms with marks
            spread = "".join(own.get(x, x) for x in unicodedata.normalize("NFD", own.get(target, target)))
            spread = unicodedata.normalize("NFC", spread)
            if spread == target:
                break
            target, seen = spread, seen + 1
        if target != ch and target != unicodedata.normalize("NFC", ch):
            out[ch] = target
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: list[str]) -> str:
    """The characters as a class of a regular expression, in ranges."""
    out, at = "", 0
    codes = sorted(map(ord, chars))
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out += f"\\x{{{codes[at]:X}}}-\\x{{{codes[end]:X}}}"
        at = end + 1
    return out


def form_sql(column: str) -> str:
    """DuckDB expression for the common form of a text column; NULL stays NULL.

    Frequent characters are translated in every text. Rare ones (letters of other planes, forms
    of several letters, selectors and tags) are only looked at in texts that hold any of them.
    """
    maps = shapes()
    often = {k: v for k, v in maps.items() if k in LOOKALIKES or 0xFF01 <= ord(k) < 0xFF5F} | dict.fromkeys(BLANKS, " ")
    rare = {k: v for k, v in maps.items() if k not in often}
    single, several = {k: v for k, v in rare.items() if len(v) == 1}, {k: v for k, v in rare.items() if len(v) > 1}
    # joiners stay between two pictures only
    j = f"regexp_replace(regexp_replace({column}, '(^|[^{PICTURES}{JOINER}]){JOINER}+', '\\1', 'g'), '{JOINER}+([^{PICTURES}{JOINER}]|$)', '\\1', 'g')"
    text = f"CASE WHEN contains({column}, '{JOINER}') THEN {j} ELSE {column} END"
    text = f"CASE WHEN regexp_matches({column}, '[{_class(list(single))}]') THEN translate({text}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))}) ELSE {text} END"
    chain = "x"
    for k, v in several.items():
        chain = f"replace({chain}, {_quoted(k)}, {_quoted(v)})"
    for base in (f"list_transform([{text}], lambda x : {chain})[1]",):
        text = f"CASE WHEN regexp_matches({column}, '[{_class(list(several))}]') THEN {base} ELSE {text} END"
    hidden = f"regexp_replace(regexp_replace({text}, '([\\p{{L}}\\p{{M}}])[{SELECTORS}]+', '\\1', 'g'), '(^|[^\\x{{1F3F4}}{TAGS}])[{TAGS}]+', '\\1', 'g')"
    text = f"CASE WHEN regexp_matches({column}, '[{SELECTORS}{TAGS}]') THEN {hidden} ELSE {text} END"
    # translate drops what has no counterpart, so the invisible characters come last
    return f"nfc_normalize(translate({text}, {_quoted(''.join(often) + INVISIBLE)}, {_quoted(''.join(often.values()))}))"


def duck():
    """A DuckDB connection for one task: one thread, bounded memory."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})


def run_sql(sql: str, schema: pa.Schema):
    """A mapInArrow function that runs ``sql`` over each batch, seen as the relation ``batch``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duck()
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("batch")

    return apply


def one_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): every text in its common form; one row per input row, NULL texts stay NULL."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), ("form", pa.string())])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run_sql(f"SELECT id, {form_sql('text')} AS form FROM batch", schema), f"id {kind}, form string").select(
        F.col("id").alias(id_col), "form"
    )


def alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>_a, <id>_b): pairs of rows whose texts have one form but differ in their characters.

    Only digests of the form and of the raw text are shuffled. Forms with a single spelling are
    dropped before any join, the join pairs spellings, and members are attached afterwards, so
    copies that are byte-identical are never paired with each other. Rows without id or text are
    in no pair; a repeated row counts once. a is the smaller id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), ("form", pa.string()), ("raw", pa.string())])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sql = f"SELECT id, md5({form_sql('text')}) AS form, md5(text) AS raw FROM batch"
    keyed = src.mapInArrow(run_sql(sql, schema), f"id {kind}, form string, raw string")
    work = Workspace(docs.sparkSession, "alike")
    keyed = work.save(keyed)
    spellings = keyed.groupBy("form", "raw").agg(F.lit(1).alias("one")).drop("one")
    several = spellings.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("form")
    few = work.save(keyed.join(several, "form", "left_semi").distinct())
    kinds = few.select("form", "raw").distinct()
    pairs = kinds.alias("x").join(kinds.alias("y"), F.expr("x.form = y.form AND x.raw < y.raw")).select(
        F.col("x.raw").alias("raw_x"), F.col("y.raw").alias("raw_y")
    )
    out = (
        pairs.join(few.select(F.col("raw").alias("raw_x"), F.col("id").alias("i")), "raw_x")
        .join(few.select(F.col("raw").alias("raw_y"), F.col("id").alias("j")), "raw_y")
        .where("i <> j")
    )
    return out.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b")).distinct()
