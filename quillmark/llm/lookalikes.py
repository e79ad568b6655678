"""One form for text that looks the same (problem 8).

DuckDB runs inside the Arrow partitions: the whole mapping is one SQL query of ``regexp_replace``, ``replace``,
``translate`` and ``nfc_normalize`` over a batch, so no Python code touches a single text. A step that few texts
need is guarded by a search for its characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.skew import expand_pairs
from quillmark.session import cut, spread, table

# Letters of other scripts, each followed by the Latin letter of the same look.
CYRILLIC = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԌG ԚQ ԜW аa еe ѕs іi јj оo "
    "УY рp сc уy хx һh ԁd ԛq ԝw ѵv ӏl"
)
GREEK = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ϲc ϳj ͿJ ϹC"
)
ARMENIAN_AND_PHONETIC = (
    "ՍU ՕO օo սu ոn ցg ɡg ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs"
)
COPTIC = (
    "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX"
)
CHEROKEE = (
    "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
)
LISU = (
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
)
# Hyphens that differ from the ordinary one only in where a line may break.
HYPHENS = "\u2010\u2011"

# What nobody sees. Soft hyphen, grapheme joiner, Arabic letter mark, Hangul fillers, Mongolian
# selectors, zero-width and directional signs, word joiner and its kin, variation selectors, byte order mark.
# The zero-width joiner (200D) and the tags (E0020 to E007F) have rules of their own.
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E001F}\x{E0080}-\x{E0FFF}]"
)
# Blanks of any width; a line's end is none of them.
BLANKS = r"[\t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2800}]"
LINE_ENDS = r"\r\n|[\r\x{0085}\x{2028}\x{2029}]"
# A joiner is seen where it makes two pictographs one. What may follow it: persons, a heart, a kiss,
# signs of gender, trade, hair, direction and weather, tools, a rainbow, animals' and fruits' colours.
PICTOGRAPH = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
JOINED_TO = (
    r"[\x{2194}\x{2195}\x{2620}\x{2640}\x{2642}\x{2695}\x{2696}\x{26A7}\x{2708}\x{2744}\x{2764}\x{27A1}\x{2B1B}\x{1F308}\x{1F33E}\x{1F373}\x{1F37C}"
    r"\x{1F384}\x{1F393}\x{1F3A4}\x{1F3A8}\x{1F3EB}\x{1F3ED}\x{1F466}-\x{1F469}\x{1F48B}\x{1F4A5}\x{1F4A8}\x{1F4AB}\x{1F4BB}\x{1F4BC}\x{1F525}\x{1F527}"
    r"\x{1F52C}\x{1F5E8}\x{1F680}\x{1F692}\x{1F7E9}\x{1F7EB}\x{1F91D}\x{1F9AF}-\x{1F9B3}\x{1F9BA}\x{1F9BC}\x{1F9BD}\x{1F9D1}\x{1F9D2}\x{1FA70}]"
)
# Tags are seen only as the spelling of a region's flag, from the black flag to the closing tag.
FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
_JOINER = "\uf8ff"

#: Kinds of compatibility mapping that keep the look; superscripts, circles, fractions and the like change it.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Characters that are drawn as the characters they stand for: letter pairs, Roman numerals, radicals, ligatures.
_DRAWN_AS = (*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0x2F00, 0x2FD6), *range(0xFB00, 0xFB18))


@cache
def presentation_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Presentation forms by the Unicode data's own rule: those of one character, and the longer ones."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    drawn = set(_DRAWN_AS)
    for code in (*_DRAWN_AS[:-24], *range(0x2100, 0x2150), *range(0x3000, 0x3400), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)):
        c = chr(code)
        kind, _, _ = unicodedata.decomposition(c).partition(" ")
        if kind in _SAME_LOOK or code in drawn and kind == "<compat>":
            plain = unicodedata.normalize("NFKC", c)
            if plain and plain != c and plain.strip():
                (one if len(plain) == 1 else more)[c] = plain
    return one, more


def lookalike_map() -> dict[str, str]:
    """Letters of other scripts by the Latin letter of the same look; digits are not letters and stay apart."""
    pairs = " ".join((CYRILLIC, GREEK, ARMENIAN_AND_PHONETIC, COPTIC, CHEROKEE, LISU)).split()
    return {pair[0]: pair[1] for pair in pairs} | dict.fromkeys(HYPHENS, "-")


@cache
def accented_lookalikes() -> tuple[dict[str, str], dict[str, str]]:
    """Composed letters of other scripts whose bare letter has a look-alike, with the same accents on that one, by the
    Unicode data's own decompositions: those that become one character, and the others."""
    looks = lookalike_map()
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        apart = unicodedata.normalize("NFD", chr(code))
        if len(apart) > 1 and apart[0] in looks and unicodedata.normalize("NFC", apart) == chr(code):
            plain = unicodedata.normalize("NFC", looks[apart[0]] + apart[1:])
            (one if len(plain) == 1 else more)[chr(code)] = plain
    return one, more


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(characters: Iterable[str]) -> str:
    """A regular expression's class of the characters, neighbours as ranges."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in spans) + "]"


@cache
def canonical_query(source: str, key: str, column: str) -> str:
    """DuckDB query for (key, form) of a source's key and text column."""
    one, more = presentation_forms()
    looks = lookalike_map()
    accented, spelled = accented_lookalikes()
    apart = "x"
    for form, plain in spelled.items():
        apart = f"replace({apart}, {_quote(form)}, {_quote(plain)})"
    long = "x"
    for form, plain in more.items():
        if ord(form) in _DRAWN_AS:
            long = f"replace({long}, {_quote(form)}, {_quote(plain)})"
    when = lambda test, then: f"case when {test} then {then} else x end"
    joined = rf"regexp_replace(x, '({PICTOGRAPH})\x{{200D}}({JOINED_TO})', '\1{_JOINER}\2', 'g')"
    joined = joined.replace("(x,", f"({joined},", 1)  # matches do not overlap: the second pass takes every other joiner
    steps = [
        f"regexp_replace(regexp_replace(regexp_replace({column}, '{LINE_ENDS}', chr(10), 'g'), '{INVISIBLE}', '', 'g'), '{BLANKS}', ' ', 'g')",
        when("contains(x, chr(8205))", f"replace(replace({joined}, chr(8205), ''), '{_JOINER}', chr(8205))"),
        when(f"regexp_matches(x, {_quote(_class(map(chr, range(0xE0020, 0xE0080))))})", rf"regexp_replace(x, '({FLAG})|[\x{{E0020}}-\x{{E007F}}]', '\1', 'g')"),
        when(f"regexp_matches(x, {_quote(_class(c for c in more if ord(c) in _DRAWN_AS))})", long),
        when(f"regexp_matches(x, {_quote(_class(one))})", f"translate(x, {_quote(''.join(one))}, {_quote(''.join(one.values()))})"),
        # letters are exchanged with their accents still apart, where they are stored so; then all is composed
        when(f"regexp_matches(x, {_quote(_class(looks))})", f"translate(x, {_quote(''.join(looks))}, {_quote(''.join(looks.values()))})"),
        "nfc_normalize(x)",
        when(f"regexp_matches(x, {_quote(_class(accented))})", f"translate(x, {_quote(''.join(accented))}, {_quote(''.join(accented.values()))})"),
        when(f"regexp_matches(x, {_quote(_class(spelled))})", f"nfc_normalize({apart})"),
    ]
    query = f"select {key}, {steps[0]} as x from {source}"
    for step in steps[1:]:
        query = f"select {key}, {step} as x from ({query})"
    return f"select {key}, x as form from ({query})"


def connection():
    """A DuckDB connection of one thread with a bounded memory, for use inside a task."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("set memory_limit = '512MB'")
    return con


def canonical_array(con, texts: pa.Array) -> pa.Array:
    """The canonical forms of an array of texts."""
    batch = pa.table({"i": pa.array(range(len(texts)), pa.int32()), "t": texts.cast(pa.string())})
    con.register("texts", batch)
    form = con.sql(f"select form from ({canonical_query('texts', 'i', 't')}) order by i").to_arrow_table().column(0).cast(pa.string())
    con.unregister("texts")
    return pa.concat_arrays(form.chunks) if form.num_chunks else pa.array([], pa.string())


def canonical_text(df: DataFrame, column: str, into: str) -> DataFrame:
    """df with one more string column, the canonical form of ``column``.

    Full-width and other presentation forms, composed and combining accents, invisible characters, blanks of
    any kind and letters of other scripts with the same look become one; accents, letter case, punctuation,
    digits and line breaks stay. Null stays null, the empty text stays empty; texts of any length are taken
    whole; repeated rows stay repeated; an empty table gives an empty one. ``into`` replaces a column of that
    name. Names are quoted, so any column name will do.
    """
    rest = [f for f in df.schema.fields if f.name != into]
    schema = df.select([F.col(f"`{f.name}`") for f in rest]).withColumn(into, F.lit("").cast("string")).schema
    schema[into].nullable = True
    place = [f.name for f in rest].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, canonical_array(con, batch.column(place))], names=[*(f.name for f in rest), into])

    return df.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ as stored but have one canonical form.

    The texts themselves are not moved: forms and stored texts meet as 128-bit hashes. Distinct texts of a form
    are paired first, then each side is expanded into its ids; a text with many copies is spread over tasks. So
    a form with a single variant, however often it is repeated, joins with nothing, and copies of one text are
    not paired. Null ids and texts take no part; a repeated row counts once; an empty text never equals one
    with visible characters.
    """
    both = canonical_text(spread(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")), "text", "form")
    hashed = both.select(  # some 40 bytes a row, kept, so that the texts pass through DuckDB once
        "id",
        F.xxhash64("form").alias("f1"),
        F.xxhash64(F.lit(1), "form").alias("f2"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit(1), "text").alias("t2"),
    )
    hashed = cut(hashed)
    texts = hashed.select("f1", "f2", "t1", "t2").distinct()
    a, b = texts.alias("a"), texts.alias("b")
    same_form = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2"))
    before = F.struct("a.t1", "a.t2") < F.struct("b.t1", "b.t2")
    links = a.join(b.hint("merge"), same_form & before).select(
        F.col("a.t1").alias("a_t1"), F.col("a.t2").alias("a_t2"), F.col("b.t1").alias("b_t1"), F.col("b.t2").alias("b_t2")
    )
    # an id may stand for several texts, so its pairs may repeat
    return expand_pairs(links, hashed.select("id", "t1", "t2").distinct(), ["t1", "t2"]).where("id_a <> id_b").distinct()


def lookalike_classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per id with the class of its canonical form: the smallest id of the class."""
    forms = canonical_text(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", "form")
    keyed = forms.select("id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"), F.col("form").isNull().alias("none"))
    classes = keyed.where("not none").groupBy("f1", "f2").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"))
    return keyed.where("not none").join(classes, ["f1", "f2"]).select("id", "class_id", "class_rows")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return canonical_text(table(spark, d, "documents").select("doc_id", "text"), "text", "form").select("doc_id", "form")


# The checking SQL goes another way: character by character, by code points and a table of pairs.
_KANA = "".join(map(chr, range(0xFF61, 0xFFA0)))


def character_forms(source: str) -> str:
    """(doc_id, text, form) by joining every character of every text with what it stands for."""
    pairs = {c: unicodedata.normalize("NFKC", c) for c in (*_KANA, *map(chr, _DRAWN_AS), *map(chr, range(0x1D400, 0x1D800)))} | lookalike_map() | accented_lookalikes()[0] | accented_lookalikes()[1]
    values = ", ".join(f"({ord(c)}, {_quote(p)})" for c, p in pairs.items())
    return f"""(
  with pairs(code, plain) as (values {values}),
  cut_ as (select doc_id, text, regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '(?s).') c from {source} where text is not null),
  chars as (select doc_id, text, unnest(c) c, generate_subscripts(c, 1) i from cut_),
  codes as (select *, unicode(c) u from chars),
  seen as (select * from codes where u not in (173, 847, 1564, 4447, 4448, 8203, 8204, 8206, 8207, 12644, 65279, 65440)
    and u not between 8234 and 8238 and u not between 8288 and 8303 and u not between 65024 and 65039 and u not between 6155 and 6159),
  beside as (select *, lag(u) over w before, lead(u) over w after from seen window w as (partition by doc_id, text order by i)),
  kept as (select * from beside where u <> 8205 or ((before between 8592 and 11263 or before between 126976 and 129791)
    and (after between 128102 and 128105 or after in (10084, 9792, 9794, 9877, 9878, 9992, 127752, 128139, 128187, 129489)))),
  plain as (select k.doc_id, k.text, i, case when u in (9, 160, 5760, 8239, 8287, 10240, 12288) or u between 8192 and 8202 then ' '
    when u in (13, 133, 8232, 8233) then chr(10) when u between 65281 and 65374 then chr(u - 65248) when p.plain is not null then p.plain else c end c
    from kept k left join pairs p on p.code = u)
  select doc_id, text, nfc_normalize(string_agg(c, '' order by i)) form from plain group by 1, 2
  union all select doc_id, text, '' from cut_ c where not exists (select 1 from plain p where p.doc_id = c.doc_id and p.text = c.text))"""


QUERIES = {"p8_found": p8_found, "p8_forms": p8_forms}
SQL = {
    "p8_found": f"with f as (select * from {character_forms('documents')}) select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id",
    "p8_forms": f"select d.doc_id, f.form from documents d left join {character_forms('documents')} f on d.doc_id = f.doc_id and d.text = f.text",
}
