"""Card extraction on invented pages."""

from pyspark.sql import functions as F

from recordlake.operators import cards

INLINE = "{n} TST000000{n}\nनिर्वाचक का नाम: {name}\n{rel}: सुरेश\nगृह संख्या: {n}-क\nउम्र: {age} लिंग: {sex}\n"


def pages(spark, texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file_id string, page_no int, page_text string")


def test_inline_cards_sections_and_headers(spark):
    first = "विधानसभा क्षेत्र: 12 अबक\nभाग संख्या: 7\nगहइ नगर\n" + INLINE.format(
        n=2, name="रमेश", rel="पिता का नाम", age="४०", sex="पुरुष"
    ) + INLINE.format(n=3, name="सीमा", rel="पति का नाम", age="14", sex="महिला")
    second = INLINE.format(n=4, name="अनीता", rel="माता का नाम", age="50", sex="म") + "DELETED"
    found = cards.extract_cards(pages(spark, [first, second]), {"district": "D"}).orderBy("page_no", "card_no").collect()
    got = [(r.page_no, r.source_serial_number, r.id_code, r.name_dev, r.relation_type, r.age, r.gender, r.status) for r in found]
    assert got == [
        (1, 2, "TST0000002", "रमेश", "FATHER", 40, "MALE", "VALID"),
        (1, 3, "TST0000003", "सीमा", "HUSBAND", 14, "FEMALE", "WARNING"),
        (2, 4, "TST0000004", "अनीता", "MOTHER", 50, "FEMALE", "REJECTED"),
    ]
    assert {r.section for r in found} == {"गहइ नगर"} and {r.part for r in found} == {"7"}
    assert {r.constituency for r in found} == {"12 अबक"} and {r.district for r in found} == {"D"}
    assert found[0].name_lat == "RAMESH" and found[1].review_reasons == ["Age 14 is outside the accepted range (18-130)"]
    assert found[0].field_confidences.overall == 0.97 and found[0].house_number == "2-क"


def test_batch_metadata_wins_but_never_erases(spark):
    page = "भाग संख्या: 7\nवार्ड संख्या: 5\n" + INLINE.format(n=2, name="रमेश", rel="पिता का नाम", age="40", sex="पुरुष")
    r = cards.extract_cards(pages(spark, [page]), {"ward": "W", "part": None}).first()
    assert (r.ward, r.part) == ("W", "7")


def test_stacked_card_and_rejects(spark):
    stacked = "9 TST0000009\nनाम\nपिता का नाम\nमकान संख्या\nआयु: 33 लिंग: पुरुष\n12\nविकास\nराहुल\n"
    noise = "निर्वाचन क्षेत्र\nनाम: लिंग\nउम्र: x\n"
    df = spark.createDataFrame([(stacked,), (noise,), ("one line",)], "card_text string")
    got = cards.parse_cards(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.name_dev, r.rel_name_dev, r.house_number, r.age, r.relation_type, r.source_serial_number) == ("विकास", "राहुल", "12", 33, "FATHER", 9)


def test_line_borders_need_data_before_a_name_line(spark):
    text = "नाम: अ\nनाम: ब\nउम्र: 20\nनाम: क\nउम्र: 30\n12 ABCDEFG\nनाम: ड"
    df = spark.createDataFrame([(text,)], "t string").select(cards.line_kinds(cards.text_lines(F.col("t"))).alias("k"))
    df = df.select(cards.notable_lines(F.col("k")).alias("n"))
    # The first name line is data itself ("name:" starts a line), so the next ones border until a code line starts afresh.
    assert df.select(cards.block_starts(F.col("n")).alias("s")).first().s == [0, 1, 3, 5]


def test_fallback_serial(spark):
    df = spark.createDataFrame([(1, 8), (None, 9), (5, 10)], "source_serial_number int, at int")
    assert [r.source_serial_number for r in cards.fallback_serial(df, "at").collect()] == [8, 9, 5]


def test_cover_pages_are_skipped(spark):
    card = INLINE.format(n=2, name="रमेश", rel="पिता का नाम", age="40", sex="पुरुष")
    kept = cards.card_pages(pages(spark, ["cover", "map " + card, "late"])).select("page_no").collect()
    assert sorted(r.page_no for r in kept) == [2, 3]


def test_header_values_end_at_the_next_label_or_line(spark):
    text = (
        "नगरपालिका: अबक विधानसभा क्षेत्र 12 गहइ भाग संख्या: ७, भाग नं. 9\nSection: 3 पथ मतदान केन्द्र - शाला (पूर्व)\nWard No. : 4b\n"
    )
    r = cards.header_fields(cards.page_facts(pages(spark, [text]))).first()
    assert (r.municipality, r.constituency, r.part, r.area, r.polling_place, r.ward) == (
        "अबक", "12 गहइ", "9", "3 पथ", "शाला (पूर्व)", "4",
    )


def test_names_that_hold_a_label_and_letters_behind_the_gender_label(spark):
    texts = [
        "O 7 ABC1234567\nनाम: नामदेव पिता का नाम रामपति\nमकान संख्या: मकान 12\nआयु: 44 लिंग: म",
        "नाम: आयुष\nपति का नाम: सर\nउम्र: 30\nPhoto is Available\n15",
        "नाम: रमा\nमाता का नाम:\nमकान नं. 4\nAge 200\nF",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, card_text string")
    got = {r.i: r for r in cards.parse_cards(df).collect()}
    assert (got[0].name_dev, got[0].rel_name_dev, got[0].relation_type) == ("नामदेव", "रामपति", "FATHER")
    assert got[0].deleted and got[0].source_serial_number == 7 and got[0].gender == "FEMALE" and got[0].house_number == "12"
    assert (got[1].name_dev, got[1].source_serial_number, got[1].age, got[1].deleted) == ("आयुष", 15, 30, False)
    assert (got[2].relation_type, got[2].rel_name_dev, got[2].house_number, got[2].age) == ("MOTHER", None, "4", None)


def test_empty_and_missing_texts_hold_no_card(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n")], "i int, card_text string")
    assert cards.parse_cards(df).count() == 0
    assert cards.card_texts(df.withColumnRenamed("card_text", "page_text")).count() == 0
