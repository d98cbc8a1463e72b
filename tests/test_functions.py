import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import carrier, ident, scalars, segments


def atom(c):
    return ident.atom_witness(c)[:16]


def test_published_hashes():
    assert ident.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert atom(0x32).hex() == "813e9b729141e7f385afa0a2d0df3e6c"
    assert atom(0x35).hex() == "b3372b584dc0df6ce757fa43f459ca1f"
    assert atom(0xD800).hex() == "dff435ed8113f31233474261aa854f0f"
    assert ident.atom_witness(0x41).hex() == "32684bfa28c0c84d6f210511aace0efc5171c7889148ba89208d5aa29705fa98"
    assert ident.composite([atom(0x32), atom(0x35), atom(0x35)]).hex() == "3b2cf619458661e7532688d3f73f3967"


def test_composites():
    a, b = atom(1), atom(2)
    assert ident.composite([a]) == a
    assert ident.composite_runs([(a, 3), (b, 2)]) == ident.composite([a, a, a, b, b])
    assert ident.composite([a, b]) != ident.composite([b, a])
    with pytest.raises(ValueError):
        ident.composite([])
    with pytest.raises(ValueError):
        ident.encode_position(0x110000)


@pytest.mark.parametrize("size", [1, 64, 65, 1023, 1024, 1025, 3000])
def test_hash_of_chunks_differs_with_every_byte(size):
    data = bytes(k % 251 for k in range(size))
    assert len({ident.blake3(data), ident.blake3(data + b"\0"), ident.blake3(data[:-1] + bytes([data[-1] ^ 1]))}) == 3


def test_blake3_of_several_chunks():
    # the published vector for 2048 bytes of the counting pattern
    data = bytes(k % 251 for k in range(2048))
    assert ident.blake3(data).hex() == "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"


def test_column_ids_follow_the_same_law(spark):
    row = spark.range(1).select(ident.composite_id(F.array(F.lit("aa"))).alias("one"), ident.composite_id(F.array(F.lit("aa"), F.lit("bb"))).alias("two"), ident.composite_id(F.array().cast("array<string>")).alias("none")).first()
    assert row["one"] == "aa" and len(row["two"]) == 32 and row["none"] is None
    a, b = spark.range(1).select(ident.record_id("d", F.lit("x"), F.lit("yz")), ident.record_id("d", F.lit("xy"), F.lit("z"))).first()
    assert a != b


def test_set_fingerprint_ignores_order_and_sequence_doesnt(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "b", 2), (2, "a", 1)], "o int, i string, g int")
    by = rows.withColumn("k", F.when((F.col("o") == 1) & (F.col("i") == "a") | (F.col("o") == 2) & (F.col("i") == "b"), 1).otherwise(2)).groupBy("k").agg(ident.set_fingerprint(F.col("i")).alias("s"), ident.sequence_fingerprint(F.col("o"), F.col("i")).alias("q")).collect()
    assert by[0]["s"] == by[1]["s"] and by[0]["q"] != by[1]["q"]


def test_carrier_vector_and_round_trip():
    c = carrier.Carrier(bytes.fromhex("d63bd9a826af91c1fea371965a64e11e"), 1, 1, 0x1880000001)
    raw = carrier.encode(c)
    assert [f"{x:016x}" for x in struct.unpack("<4Q", raw)] == ["3ff1645a9671a3fe", "bff93546c9deb0f7", "3ff000000070646b", "3ff0003100010001"]
    assert carrier.decode(raw) == c and carrier.atom_of(c.metadata) == ord("1") and carrier.tier_of(c.metadata) == 0
    far = carrier.Carrier(bytes(range(16)), 70_000, 65535, carrier.metadata_of(31, 0x10FFFF))
    assert carrier.decode(carrier.encode(far)) == far._replace(ordinal=0) and carrier.tier_of(far.metadata) == 31
    assert all(math.isfinite(x) and 1 <= abs(x) < 2 for x in struct.unpack("<4d", raw))
    assert carrier.run_pieces(65536) == [65535, 1]
    with pytest.raises(ValueError):
        carrier.decode(bytes(32))


def test_hilbert_keys_are_those_of_single_points():
    rng = np.random.default_rng(4)
    for bits in (1, 2, 8, 32):
        points = rng.integers(0, 1 << bits, (200, 4), dtype=np.int64)
        assert [int(k, 16) for k in scalars.hilbert_keys(points, bits)] == [scalars.hilbert_index(list(map(int, p)), bits) for p in points]


def test_hilbert_curve_visits_neighbours():
    at = sorted(((scalars.hilbert_index([x, y, z, w], 2), (x, y, z, w)) for x in range(4) for y in range(4) for z in range(4) for w in range(4)))
    assert [k for k, _ in at] == list(range(256))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(at, at[1:], strict=False))


def test_placement_is_on_the_sphere(spark):
    norm = sum(c * c for c in scalars.placement(F.col("id"), F.lit(50)))
    assert all(abs(r[0] - 1) < 1e-12 for r in spark.range(50).select(norm).collect())


def test_masks_and_fractions(spark):
    row = spark.range(1).select(scalars.has_any(F.lit(20), 29), scalars.has_all(F.lit(20), 29), scalars.write_partition(F.lit("ff00")), scalars.reduced(F.lit(2), F.lit(4)), scalars.reduced(F.lit(1), F.lit(4)), scalars.decomposed(F.lit("é"))).first()
    assert tuple(row) == (True, False, 63, False, True, "é")


def test_segments_follow_the_boundary_rules():
    assert segments.graphemes("é\r\n🇩🇪🇫🇷👩‍👩가각") == ["é", "\r\n", "🇩🇪", "🇫🇷", "👩‍👩", "가", "각"]
    assert segments.words("The quick (“brown”) fox can’t jump 32.3 feet, right?") == ["The", " ", "quick", " ", "(", "“", "brown", "”", ")", " ", "fox", " ", "can’t", " ", "jump", " ", "32.3", " ", "feet", ",", " ", "right", "?"]
    cases = {
        "c.d": ["c.d"], "3.4": ["3.4"], "U.S. Army": ["U.S. ", "Army"], "the resp. leaders are": ["the resp. leaders are"], "etc.)’ ‘(the": ["etc.)’ ‘(the"], "etc.)’ ‘(The": ["etc.)’ ", "‘(The"],
        "He said “Go!” Then left. OK?\n\nNew\r\nx": ["He said “Go!” ", "Then left. ", "OK?\n", "\n", "New\r\n", "x"], "字。文": ["字。", "文"], "Why?, he said.": ["Why?, he said."], "1. A": ["1. ", "A"], "A̧.B": ["A̧.B"], "!A": ["!", "A"], "": [],
    }
    for text, want in cases.items():
        assert segments.sentences(text) == want, text


def test_segments_tile_any_text():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("aB1. ?!,)\n\r̀‍一א'_\U0001f1e9한  ") for _ in range(draw.randrange(40)))
        for found in (segments.graphemes, segments.words, segments.sentences):
            parts = found(text)
            assert "".join(parts) == text and all(parts)


def test_segments_of_long_texts_take_linear_time():
    for text in ("a. " * 200_000, "." * 300_000, "a.(" * 100_000 + "b", "̀" * 200_000 + "."):
        began = time.monotonic()
        assert "".join(segments.sentences(text)) == text and time.monotonic() - began < 20
