"""Problem 5: letter case and look-alikes together."""

import pyarrow as pa

from skein.llm import glyphs


def test_letter_and_capital_end_alike():
    letters = [c for c in map(chr, range(0x370, 0x590)) if c.isalpha() and len(c.upper()) == 1 and c.upper().lower() == c]
    small, capital = (glyphs.one_form(pa.array(x), small=True).to_pylist() for x in (letters, [c.upper() for c in letters]))
    assert small == capital


def test_quote_in_another_case(spark):
    pages = spark.createDataFrame([(1, "Вечером новый мост открыли для всех."), (2, "Ο νέος σταθμός υπό την πόλη"), (3, "The BENCH near the van"), (4, "A gap of 5 μm is left")], "result_id long, text string")
    rows = [
        (1, 1, "ВЕЧЕРОМ НОВЫЙ\u00a0МОСТ"), (2, 1, "НО\u200bВЫЙ МОСТ ОТКРЫЛИ"), (3, 2, "ΝΈΟΣ\u00a0ΣΤΑΘΜΌΣ ΥΠΌ"), (4, 3, "the ВEΝCH"), (5, 3, "νan"),
        (6, 4, "gap\u00a0of 5 mm"), (7, 1, "СТАРЫЙ\u00a0МОСТ"), (8, 1, "новый мост"), (9, 1, None), (10, 1, "\u200b"),
    ]
    cites = spark.createDataFrame(rows, "citation_id long, result_id long, quote string")
    assert {r.citation_id for r in glyphs.found_only_by_form(cites, pages).collect()} == {1, 2, 3, 4, 5}
