"""Page text -> cards -> records: header fields, sections, block borders, card fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import card_patterns as P
from ..functions import fixed, labels
from ..functions.text import (
    normalize_devanagari,
    normalize_house,
    normalize_id_code,
    normalize_ocr_text,
    trim_ws,
)
from ..functions.translit import to_latin
from ..session import cut_lineage
from .keyed import attach_by_key, carry_forward, filter_late
from .records import as_records, blank_null, record_key, with_defaults


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed group of the first match, NULL when there is none."""
    return F.when(text.rlike(pattern), trim_ws(F.regexp_extract(text, pattern, group)))


# ----------------------------------------------------------- header fields
def page_facts(pages: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per page, in one scan: header fields found on it, its section heading, whether it holds cards.

    With ``patterns`` the fields are the first groups of these patterns in
    place of the labelled values of a register page.
    """
    text = F.col("page_text")
    if patterns is not None:
        fields = {n: first_match(text, p) for n, p in patterns.items()}
    else:
        pages = pages.withColumn("_entries", labels.entries(text, P.HEADER_LABELS))
        fields = {n: header_value(F.col("_entries"), n) for n in P.HEADER_FIELDS}
    return pages.select(
        "file_id",
        "page_no",
        *[value.alias(n) for n, value in fields.items()],
        section_of_page(text).alias("section_found"),
        has_cards(F.col("page_no"), text).alias("has_cards"),
    )


def header_value(found: Column, field: str) -> Column:
    """First usable value of a header field: a number where one is wanted, else any text."""
    if field in P.NUMBER_FIELDS:
        value = labels.first_entry(found, field, when=lambda v: v.rlike("^[0-9]"))["value"]
        return F.regexp_extract(value, "^[0-9]+", 0)
    return labels.first_entry(found, field, when=lambda v: v != "")["value"]


def header_fields(facts: DataFrame, fields: Sequence[str] = tuple(P.HEADER_FIELDS)) -> DataFrame:
    """Per file, the first match of every header field in page order, and its page count."""
    firsts = [
        F.min(F.when(F.col(n).isNotNull(), F.struct("page_no", n)))[n].alias(n) for n in fields
    ]
    return facts.groupBy("file_id").agg(F.count(F.lit(1)).alias("key_rows"), *firsts)


def merge_metadata(batch: Column, extracted: Column) -> Column:
    """Batch metadata wins where it is given; a missing value never erases a found one."""
    return F.coalesce(blank_null(batch), extracted)


# ----------------------------------------------------------------- blocks
def text_lines(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), trim_ws), lambda x: x != "")


def _is_serial(word: Column) -> Column:
    return word.rlike("^[0-9]{1,4}$")


def _is_code(word: Column) -> Column:
    return word.rlike("(?i)^[A-Z0-9/_-]{6}")


def line_kinds(lines: Column) -> Column:
    """What every line can mean for the borders of cards.

    ``opens``: serial number and code; ``names``: starts with a name label;
    ``data``: shows that a card holds data; ``card``: marks a block as a card;
    ``chunk``: starts with a plain name label.
    """
    every = [x for words in P.CARD_LABELS.values() for x in words]

    def kind(line: Column) -> Column:
        words = F.split(line, r"\s+", 3)
        opens = _is_serial(F.get(words, 0)) & F.coalesce(_is_code(F.get(words, 1)), F.lit(False))
        found = labels.labels_with_colon(line, every)
        plain = labels.starts_with_label(line, [P.PLAIN_NAME])
        return F.struct(
            opens.alias("opens"),
            (labels.starts_with_label(line, P.NAME_HEADS) & ~line.contains(P.NOT_A_NAME_LINE)).alias("names"),
            (plain | labels.overlaps(found, P.DATA_LABELS)).alias("data"),
            (opens | plain | labels.overlaps(found, P.BLOCK_LABELS)).alias("card"),
            labels.starts_with_label(line, P.CHUNK_HEADS).alias("chunk"),
        )

    return F.transform(lines, kind)


def _positions(kinds: Column) -> Column:
    return F.transform(kinds, lambda k, i: F.struct(i.alias("at"), k.alias("kind")))


def block_starts(notable: Column) -> Column:
    """0-based line numbers at which a new block starts, from the ``notable_lines``.

    A serial + code line always starts one; a name line does when the notable
    line before it is one with data. The page text stays in its row.
    """

    def starts(x: Column, i: Column) -> Column:
        after_data = (i > 0) & F.coalesce(F.get(notable, i - 1)["kind"]["data"], F.lit(False))
        return (x["at"] > 0) & (x["kind"]["opens"] | (x["kind"]["names"] & after_data))

    return F.concat(F.array(F.lit(0)), F.transform(F.filter(notable, starts), lambda x: x["at"]))


def notable_lines(kinds: Column) -> Column:
    """Lines that matter for borders, with their numbers."""
    return F.filter(_positions(kinds), lambda x: x["kind"]["opens"] | x["kind"]["names"] | x["kind"]["data"])


def chunk_starts(kinds: Column) -> Column:
    """0-based line numbers at which the cut in front of plain name labels starts a chunk."""
    heads = F.filter(_positions(kinds), lambda x: x["kind"]["chunk"] & (x["at"] > 0))
    return F.concat(F.array(F.lit(0)), F.transform(heads, lambda x: x["at"]))


def blocks_at(lines: Column, starts: Column, keep=None) -> Column:
    """Lines from every start up to the next, joined by line ends; short ones and those not to keep go.

    ``keep`` takes the block's first line number (from 0) and its number of lines.
    """
    size = F.size(lines)

    def block(begin: Column, i: Column) -> Column:
        n = F.coalesce(F.get(starts, i + 1), size) - begin
        text = F.array_join(F.slice(lines, begin + 1, n), "\n")
        return text if keep is None else F.when(keep(begin, n), text)

    return F.filter(F.transform(starts, block), lambda x: F.length(x) >= P.MIN_CARD_CHARS)


def card_texts(pages: DataFrame) -> DataFrame:
    """One row per card text of a page: ``card_no`` (from 0) and ``card_text``.

    Per page the line borders are used when they give at least as many blocks
    as the label split, else the label split is.
    """
    c = F.col
    cut = pages.withColumn("_lines", text_lines(c("page_text")))
    cut = cut.withColumn("_kinds", line_kinds(c("_lines")))
    cut = cut.withColumn("_notable", notable_lines(c("_kinds")))
    cut = cut.withColumns({"_starts": block_starts(c("_notable")), "_chunks": chunk_starts(c("_kinds"))})

    def holds_card(begin: Column, n: Column) -> Column:
        return F.exists(F.slice(c("_kinds"), begin + 1, n), lambda k: k["card"])

    cut = cut.withColumns(
        {
            "_by_line": blocks_at(c("_lines"), c("_starts"), holds_card),
            "_by_label": blocks_at(c("_lines"), c("_chunks")),
        }
    )
    best = F.when(F.size("_by_line") >= F.size("_by_label"), c("_by_line")).otherwise(c("_by_label"))
    return cut.select(*pages.columns, F.posexplode(best).alias("card_no", "card_text"))


# ------------------------------------------------------------- card fields
_AGE_DIGITS = "^[0-9०-९]{1,3}"


def _age(value: Column) -> Column:
    digits = F.translate(F.regexp_extract(value, _AGE_DIGITS, 0), fixed.DEVANAGARI_DIGITS, fixed.ASCII_DIGITS)
    age = digits.try_cast("int")
    return F.when(age.between(1, 125), age)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}]+")


def _gender(words: Column, labelled: Column) -> Column:
    """Code of a gender word; ``labelled`` is the value behind the gender label, where single letters count too."""

    def among(options: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(x) for x in options]))

    letter = F.coalesce(F.get(_words(labelled), 0), F.lit(""))
    male, female = among(P.MALE_WORDS) | (letter == P.MALE_LETTER), among(P.FEMALE_WORDS) | (letter == P.FEMALE_LETTER)
    return F.when(male, "MALE").when(female, "FEMALE").otherwise("UNKNOWN")


def _serial_mark(lines: Column) -> Column:
    """(deletion letter found, serial number) of a card.

    It stands at the top, alone or before a code or the photo mark; else at
    the bottom below the photo mark; else the first line ending in a number has it.
    """
    none = F.lit(None).cast("struct<letter:boolean,number:int>")

    def mark(letter: Column, number: Column) -> Column:
        return F.struct(letter.alias("letter"), number.try_cast("int").alias("number"))

    words = F.split(F.get(lines, 0), r"\s+")
    letter = F.upper(F.get(words, 0)) == P.DELETED_LETTER
    at = F.when(letter, 1).otherwise(0)
    number, behind = F.get(words, at), F.get(words, at + 1)
    fits = behind.isNull() | _is_code(behind) | F.lower(behind).startswith("photo")
    top = F.when(_is_serial(number) & fits, mark(letter, number)).otherwise(none)

    ends = r"(?i)(?<![A-Za-z0-9_])(O\s+)?([0-9]{1,4})$"

    def end_mark(line: Column) -> Column:
        return mark(F.regexp_extract(line, ends, 1) != "", F.regexp_extract(line, ends, 2))

    last, before = F.get(lines, F.size(lines) - 1), F.get(lines, F.size(lines) - 2)
    below_photo = F.lower(before).endswith("available") & last.rlike("(?i)^" + ends)
    ending = F.get(F.filter(lines, lambda x: x.rlike(ends)), 0)
    return F.coalesce(
        top, F.when(below_photo, end_mark(last)).otherwise(none), F.when(ending.isNotNull(), end_mark(ending)).otherwise(none)
    )


def parse_cards(cards: DataFrame) -> DataFrame:
    """Fields of every card text; texts that are no card are dropped.

    Adds serial, id code, names, relation, house, age, gender and the deletion
    mark. A card is cut once into labels with their values. Both the inline
    layout ("label: value") and the stacked one (labels first, values below
    the age line) are read.
    """
    c = F.col
    text = c("card_text")
    id_code = "(?i)(?<![A-Za-z0-9_])(" + "|".join(P.ID_CODE_SHAPES) + ")(?![A-Za-z0-9_])"
    marks = cards.withColumns(
        {
            "_lines": text_lines(text),
            "_entries": labels.entries(text, P.CARD_LABELS),
            "_code": blank_null(F.regexp_extract(text, id_code, 1)),
        }
    )
    age_line = labels.any_label(P.CARD_LABELS["age"])
    age_flags = F.transform(c("_lines"), lambda x: x.rlike(f"^{age_line}\\s*[:：-]?\\s*[0-9०-९]"))
    marks = marks.withColumns(
        {"_serial": _serial_mark(c("_lines")), "_age_at": F.array_position(age_flags, True).cast("int") - 1}
    )
    stacked = (c("_age_at") >= 3) & (F.size("_lines") > c("_age_at") + 2)
    marks = marks.withColumn("_stacked", stacked)

    def below(n: int) -> Column:
        value = F.get(c("_lines"), c("_age_at") + n)
        furniture = value.contains("Photo") | value.contains(F.coalesce(c("_code"), F.lit("___")))
        return F.when(~furniture, value)

    def value_of(*fields: str) -> Column:
        return labels.first_entry(c("_entries"), *fields)["value"]

    relations = F.filter(c("_entries"), lambda x: x["field"].isin(*P.RELATIONS))
    ranked = [labels.first_entry(c("_entries"), kind) for kind in P.RELATIONS]
    relation = F.when(c("_stacked"), F.get(relations, 0)).otherwise(F.coalesce(*ranked))
    house_found = value_of("house")
    inline_house = F.when(house_found == "", value_of("house_word")).otherwise(house_found)
    aged = labels.first_entry(c("_entries"), "age", when=lambda v: v.rlike(_AGE_DIGITS))["value"]
    scope = F.when(c("_stacked"), F.get(c("_lines"), c("_age_at"))).otherwise(text)
    marks = marks.withColumns({"_relation": relation, "_scope": _words(scope)})
    in_text = F.array_contains(_words(text), P.DELETED_WORD)
    raw = marks.withColumns(
        {
            "_name": F.when(c("_stacked"), below(2)).otherwise(value_of("name")),
            "_rel": F.when(c("_stacked"), below(3)).otherwise(c("_relation")["value"]),
            "_house": F.when(c("_stacked"), below(1)).otherwise(inline_house),
            "relation_type": F.coalesce(c("_relation")["field"], F.lit("OTHER")),
            "age": _age(aged),
            "gender": _gender(c("_scope"), value_of("gender")),
            "deleted": F.coalesce(c("_serial")["letter"] | (c("_serial").isNotNull() & in_text), F.lit(False)),
            "_number": F.nullif(c("_serial")["number"], F.lit(0)),
        }
    )
    cleaned = raw.withColumns(
        {
            "id_code": blank_null(normalize_id_code(c("_code"))),
            "name_dev": blank_null(normalize_devanagari(normalize_ocr_text(c("_name")))),
            "rel_name_dev": blank_null(normalize_devanagari(normalize_ocr_text(c("_rel")))),
            "house_number": blank_null(normalize_house(normalize_ocr_text(c("_house")))),
            "source_serial_number": F.coalesce("_number", F.lit(1)),
        }
    )
    furniture = F.coalesce(
        (c("name_dev") == P.NOT_A_NAME) | c("name_dev").rlike("|".join(P.NOT_IN_A_NAME)), F.lit(False)
    )
    is_card = (F.size("_lines") >= 2) & (c("name_dev").isNotNull() | c("id_code").isNotNull()) & ~furniture
    kept = filter_late(cleaned, is_card)
    named = kept.withColumns(
        {
            "name_lat": blank_null(to_latin(c("name_dev"))),
            "rel_name_lat": blank_null(to_latin(c("rel_name_dev"))),
            "review_reasons": review_reasons(c("id_code"), c("age"), c("deleted")),
            "confidence": card_confidence(c("id_code")),
        }
    )
    return named.withColumns(
        {
            "status": card_status(c("deleted"), c("review_reasons")),
            "field_confidences": field_confidences(),
        }
    ).drop(*[x for x in raw.columns if x.startswith("_")])


def review_reasons(id_code: Column, age: Column, deleted: Column) -> Column:
    """Why a person should look at a card."""
    age_reason = (
        F.when(F.coalesce(age, F.lit(0)) == 0, P.NO_AGE)
        .when(~age.between(18, 130), F.concat(F.lit("Age "), age.cast("string"), F.lit(" " + P.AGE_RANGE)))
    )
    return F.array_compact(
        F.array(F.when(id_code.isNull(), P.NO_ID_CODE), age_reason, F.when(deleted, P.MARKED_DELETED))
    )


def card_status(deleted: Column, reasons: Column) -> Column:
    """REJECTED when marked deleted, WARNING with any reason, else VALID."""
    return F.when(deleted, "REJECTED").when(F.size(reasons) > 0, "WARNING").otherwise("VALID")


def card_confidence(id_code: Column) -> Column:
    return F.when(id_code.isNotNull(), P.CONFIDENCE_WITH_CODE).otherwise(P.CONFIDENCE_WITHOUT_CODE)


def field_confidences() -> Column:
    """Per-field confidence struct. What is present scores, the rest is 0."""

    def present(name: str, test: Column, score: float, absent: float = 0.0) -> Column:
        return F.when(test, score).otherwise(absent).alias(name)

    c = F.col
    return F.struct(
        present("name", c("name_dev").isNotNull(), 0.98),
        present("id_code", c("id_code").isNotNull(), 0.99),
        present("relation", c("rel_name_dev").isNotNull(), 0.95),
        present("house", c("house_number").isNotNull(), 0.95),
        present("age", c("age").isNotNull(), 0.98),
        present("gender", c("gender") != "UNKNOWN", 0.98),
        present("overall", c("id_code").isNotNull(), 0.97, 0.70),
    )


def fallback_serial(cards: DataFrame, position: str) -> DataFrame:
    """Use the card's position where no serial (or only the default 1) was read."""
    serial = F.col("source_serial_number")
    return cards.withColumn(
        "source_serial_number", F.when(F.coalesce(serial, F.lit(1)) == 1, F.col(position)).otherwise(serial)
    )


# -------------------------------------------------------------------- job
def section_of_page(text: Column) -> Column:
    """Section heading on a page, NULL when the page has none."""

    def heading(line: Column) -> Column:
        place = F.lit(False)
        for word in P.SECTION_WORDS:
            place = place | line.contains(word)
        for word in P.NOT_A_SECTION:
            place = place & ~line.contains(word)
        return place & (F.length(line) >= P.MIN_SECTION_CHARS) & line.rlike(r"^[\u0900-\u097F,][\u0900-\u097F\s,0-9-]*$")

    return F.regexp_replace(F.get(F.filter(text_lines(text), heading), 0), r"\s+", " ")


def has_cards(page_no: Column, text: Column) -> Column:
    """False for cover and map pages: pages 1 and 2 need a box mark."""
    marked = F.lit(False)
    for m in P.BOX_MARKS:
        marked = marked | text.contains(m)
    return (page_no > 2) | marked


def card_pages(pages: DataFrame) -> DataFrame:
    """Pages that may hold cards."""
    return pages.where(has_cards(F.col("page_no"), F.col("page_text")))


def extract_cards(pages: DataFrame, batch_metadata: dict[str, str] | None = None) -> DataFrame:
    """Cards of every page of ``pages(file_id, page_no, page_text)`` with their section and header fields.

    Page texts are read twice: once for the narrow page facts, which are
    written because two steps use them, and once for the cards.
    """
    meta = batch_metadata or {}
    facts = cut_lineage(page_facts(pages), "page-facts")
    found = facts.where("has_cards").select("file_id", "page_no", "section_found")
    sections = carry_forward(found, "file_id", "page_no", "section_found", "section").drop("section_found")
    cards = parse_cards(card_texts(card_pages(pages))).drop("page_text")
    wide = cards.join(sections, ["file_id", "page_no"], "left")
    wide = attach_by_key(
        wide, header_fields(facts), ["file_id"], list(P.HEADER_FIELDS), ["file_id", "page_no", "card_no"]
    )
    merged = {
        n: merge_metadata(F.lit(meta.get(n)).cast("string"), F.col(n)) for n in P.HEADER_FIELDS
    }
    merged["area"] = F.coalesce(F.col("section"), merged["area"])
    merged["district"] = F.lit(meta.get("district")).cast("string")
    return wide.withColumns(merged)


def cards_to_records(cards: DataFrame, batch_metadata: dict[str, str] | None = None) -> DataFrame:
    """Canonical records from extracted cards; the input order is (page, card)."""
    shaped = cards.withColumns(
        {
            "record_id": record_key(F.col("file_id"), F.col("page_no"), F.col("card_no")),
            "source_file_id": F.col("file_id").cast("string"),
            "source_page_number": F.col("page_no").cast("int"),
            "photo_available": F.lit(True),
            "ingest_seq": F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("card_no"),
            "raw": F.to_json(F.struct("card_text", F.col("page_no").alias("page"), "deleted")),
        }
    )
    return as_records(with_defaults(shaped, batch_metadata))


def extraction_report(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """Per file: pages, records, records to review, measured average confidence."""
    needs_review = F.size("review_reasons") > 0
    per_file = cards.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(needs_review).alias("records_to_review"),
        F.count_if(F.col("id_code").isNull()).alias("id_code_reviews"),
        F.count_if(~F.coalesce(F.col("age").between(18, 130), F.lit(False))).alias("age_reviews"),
        F.round(F.avg(F.col("confidence").cast("decimal(18,6)")), 4).cast("double").alias("average_confidence"),
    )
    per_pages = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"))
    joined = per_pages.join(per_file, "file_id", "left")
    counts = ["records", "records_to_review", "id_code_reviews", "age_reviews"]
    return joined.select(
        "file_id", "pages", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], "average_confidence"
    )
