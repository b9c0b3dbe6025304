"""Text that looks the same, brought to one form by SQL embedded in Arrow partitions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.session import ship

# Letters of other scripts and the letters they look like, in Unicode order.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "⁄": "/", "∕": "/", "․": ".", "‚": ",", "ʹ": "'", "ʼ": "'", "‘": "'", "’": "'", "′": "'", "`": "'", "´": "'",
}
# Ranges of characters that show nothing, and of blanks.
INVISIBLE = r"[\x{0000}-\x{0008}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
BLANKS = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Where compatibility forms of single letters, digits and signs are.
COMPATIBLE = ((0xFF01, 0xFF5E), (0xFF61, 0xFF9F), (0x1D400, 0x1D7FF), (0x24B6, 0x24E9), (0x2100, 0x214F), (0x2160, 0x217F), (0x2070, 0x209C), (0x00B2, 0x00B3), (0x00B9, 0x00B9))
#: Where compatibility forms that are written with several letters are: ligatures, digraphs, Roman numerals, leaders.
WRITTEN_OUT = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2025, 0x2026))
# What moving, copying, cropping, converting or re-casing leaves in a file name.
TRACES = r"(?:\.(?:png|jpe?g|tiff?|webp|bmp|gif)|[ _-]*\([0-9]+\)|[ _-]+(?:copy|copie|kopie|copia|crop|cropped)(?:[ _-]?[0-9]{1,2})?|[ ._-])+$"


def _compatible() -> tuple[str, str]:
    pairs = [(chr(c), n) for a, b in COMPATIBLE for c in range(a, b + 1) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plainly(column: str) -> str:
    """DuckDB expression of a text with its compatibility forms as plain letters."""
    a, b = _compatible()
    spans = "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in (*COMPATIBLE, *WRITTEN_OUT))
    out = f"translate({column}, {_quoted(a)}, {_quoted(b)})"
    for x, y in WRITTEN_OUT:
        for c in map(chr, range(x, y + 1)):
            if len(n := unicodedata.normalize("NFKC", c)) > 1:
                out = f"replace({out}, {_quoted(c)}, {_quoted(n)})"
    return f"CASE WHEN regexp_matches({column}, '[{spans}]') THEN {out} ELSE {column} END"


def _query(column: str, kind: str) -> str:
    """DuckDB query of the one form: without invisible characters, compatibility forms as plain ones,
    look-alikes as one letter, NFC, every blank as a space, none at the ends. ``name`` also drops
    case and folders; case goes before look-alikes are mapped, in ``capitals`` after and before.
    ``image`` is a name without the traces of handling."""
    fold = kind != "text"
    letters = f"SELECT * REPLACE ((CASE WHEN regexp_matches({column}, '[^ -~]') THEN nfc_normalize(translate({column}, {_quoted(''.join(LOOKALIKES))}, {_quoted(''.join(LOOKALIKES.values()))})) ELSE {column} END) AS {column}) FROM ({{}})"
    steps = [
        f"SELECT * REPLACE (regexp_replace({column}, '{INVISIBLE}', '', 'g') AS {column}) FROM batch",
        f"SELECT * REPLACE (({plainly(column)}) AS {column}) FROM ({{}})",
        *([letters] if kind == "capitals" else []),
        *([f"SELECT * REPLACE (lower(nfc_normalize({column})) AS {column}) FROM ({{}})"] if fold else []),
        letters,
        f"SELECT * REPLACE (trim(regexp_replace({column}, '{BLANKS}', ' ', 'g')) AS {column}) FROM ({{}})",
    ]
    if fold:
        steps.append(rf"SELECT * REPLACE (regexp_replace({column}, '^.*[/\\]', '') AS {column}) FROM ({{}})")
    if kind == "image":
        steps.append(f"SELECT * REPLACE ({_untraced(column)} AS {column}) FROM ({{}})")
    out = steps[0]
    for s in steps[1:]:
        out = s.replace("{}", out)
    return out


def _untraced(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^copy of ', ''), '{TRACES}', '')"


def _connected():
    """DuckDB in a Python worker: one thread, bounded memory, nothing spilled to the machine's disk."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''; SET preserve_insertion_order = true")
    return con


def _made(con, sql: str, texts: pa.Array) -> list[pa.Array]:
    """The columns that a query over the table ``batch`` of one column ``form`` makes."""
    con.register("batch", pa.table({"form": texts}))
    out = con.sql(sql).to_arrow_table()
    con.unregister("batch")
    flat = [c.combine_chunks().cast(pa.string()) for c in out.columns]
    return [c if isinstance(c, pa.Array) else c.chunk(0) for c in flat]


def one_form(df: DataFrame, text_col: str, kind: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., ``form``) of every row: the text in the one form, or with kind="image" the folded image name.

    Null stays null, blank and invisible texts become empty. Long texts are taken
    whole. Rows keep their order within a partition; nothing is shuffled. A kept
    column may have any name but ``form``.
    """
    if kind not in ("text", "name", "image"):
        raise ValueError(kind)
    if "form" in keep:
        raise ValueError("form is the name of the result")
    ship(df.sparkSession)
    src = df.select(*keep, F.col(text_col).alias("form"))
    sql = _query("form", kind)
    names = src.columns

    def run(batches):
        con = _connected()
        for b in batches:
            (made,) = _made(con, sql, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), made], names=names)

    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in src.dtypes))


def image_names(df: DataFrame, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., ``name``, ``image``): the folded file name and, without the traces of handling, what it says of the image.

    A capital may look like another letter than its small one does, so a name of other
    than plain letters that comes out differently when capitals are mapped before case is
    folded has a second row: names that are one in form are one in one of their rows.
    Null and blank names, and names of traces alone, give no row.
    """
    if {"name", "image"} & set(keep):
        raise ValueError("name and image are the names of the result")
    ship(df.sparkSession)
    src = df.select(*keep, F.col(text_col).alias("name"))
    sql = {k: f"SELECT form, {_untraced('form')} AS image FROM ({_query('form', k)})" for k in ("name", "capitals")}
    names = [*src.columns, "image"]

    def run(batches):
        con = _connected()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            name, image = _made(con, sql["name"], texts)
            yield pa.RecordBatch.from_arrays([*kept, name, image], names=names)
            at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, "[^ -~]"), False))
            if len(at):
                other, image2 = _made(con, sql["capitals"], texts.take(at))
                new = pc.not_equal(other, name.take(at))
                at = at.filter(new)
                yield pa.RecordBatch.from_arrays([*(k.take(at) for k in kept), other.filter(new), image2.filter(new)], names=names)

    types = dict(src.dtypes)
    out = src.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in src.columns), "image string"]))
    return out.where("image <> ''")


def same_image(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``same_image``: whether two folded names differ by traces of handling only."""
    src = pairs.drop("same_image")
    names = [*src.columns, "same_image"]
    places = [src.columns.index(a), src.columns.index(b)]

    def run(batches):
        con = _connected()
        for batch in batches:
            images = [_made(con, f"SELECT {_untraced('form')} FROM batch", batch.column(i))[0] for i in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.equal(*images)], names=names)

    ship(pairs.sparkSession)
    return src.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in src.dtypes), "same_image boolean"]))


def registered_spelling(rows: DataFrame, id_col: str, text_col: str, register: DataFrame, register_col: str) -> DataFrame:
    """(id, registered) of the rows whose text is no registered one, character for character, but looks the same as one.

    If several registered texts look the same, the first in character order is
    given. Null and blank texts are no cases.
    """
    known = register.select(F.col(register_col).alias("registered")).where("registered is not null").distinct()
    other = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(known, F.col("t") == F.col("registered"), "left_anti")
    forms = one_form(known, "registered", keep=("registered",)).where("form <> ''").groupBy("form").agg(F.min("registered").alias("registered"))
    return one_form(other, "t", keep=("id",)).where("form <> ''").join(forms, "form").select("id", "registered")
