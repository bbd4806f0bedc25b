"""The sound key: spellings of one name agree, different names do not, in both scripts."""

import pytest

from recordlake.functions.phonetic import sound_key
from pyspark.sql import functions as F

SAME = [
    ("राम", "Ram", "Raam", "raama"), ("गीता", "Geeta", "Gita", "Githa"), ("महेश", "Mahesh", "MAHES"), ("कहानी", "Kahani", "kahaani"),
    ("लक्ष्मी", "Lakshmi", "Laxmi", "Lakshmee"), ("सिंह", "Singh", "Sinh"), ("अंबिका", "अम्बिका", "Ambika", "Ambikaa"),
    ("ज्ञान", "Gyan", "Jnan"), ("भारत", "Bharat", "Barat"), ("आशा", "Asha", "Aasha"), ("छाया", "Chhaya", "Chaya"), ("विनय", "Vinay", "Winay"),
    ("राम दयाल", "Ram Dayal", "ram-dayaal"), ("पट्टी", "Patti", "Pati"),
]


def keys(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.k for r in df.orderBy("i").select(sound_key(F.col("t")).alias("k")).collect()]


def test_spellings_of_one_name_agree_and_names_differ(spark):
    found = [set(keys(spark, names)) for names in SAME]
    assert [(names, got) for names, got in zip(SAME, found) if len(got) > 1] == []
    assert len({next(iter(x)) for x in found}) == len(SAME)


@pytest.mark.parametrize("text", [None, "", " 12 .,", "्"])
def test_nothing_sounds(spark, text):
    assert keys(spark, [text]) == [None]
