import re
import unicodedata

from pyspark.sql import functions as F

from docloom.functions import identity


def test_composed_characters_stay_as_they_are(spark):
    """No character that is kept from Python is changed by NFC or joins one before it."""
    kept = re.compile(f"[{identity._COMPOSED}]")
    joined = {int(x, 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" for x in d.split()[1:]}
    held = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and kept.match(chr(c))]
    assert len(held) > 20_000 and not any(unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or ord(c) in joined for c in held)
    texts = ["é “ok” – 中文 €", "é", "Å ngstrom", "가", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(identity.nfc(F.col("t"))).collect()
    assert [r[0] for r in got] == [t and unicodedata.normalize("NFC", t) for t in texts]
