"""Full normalization against a walk over single characters, and quotes found by it at their raw places."""

import random
import unicodedata

from veritrail.functions import text
from veritrail.operators import quotes

PIECES = ["ab", "C-\n", "d", " ", "\n", "\t", "-", "- \n ", "ﬁ", "ﬄ", "ß", "İ", "é", "é", "½", "漢", "😀", " ", "-\n\n", "x1", " ", "Ⅳ", "ǆ"]


def walked(raw):
    """(character, raw offset) pairs, a character at a time."""
    flat = [(out, i) for i, c in enumerate(raw) for piece in unicodedata.normalize("NFKC", c) for out in text.LIGATURES.get(piece, piece)]
    word = lambda c: c.isalnum() or c == "_"
    out, i = [], 0
    while i < len(flat):
        c, at = flat[i]
        j = i + 1
        while j < len(flat) and flat[j][0].isspace():
            j += 1
        gap = [x for x, _ in flat[i + 1 : j]]
        if c == "-" and i and word(flat[i - 1][0]) and "\n" in gap and j < len(flat) and word(flat[j][0]):
            i = j
        elif c.isspace():
            out.append((" ", at))
            i = j
        else:
            out += [(x, at) for x in c.casefold()]
            i += 1
    while out and out[0][0] == " ":
        out.pop(0)
    while out and out[-1][0] == " ":
        out.pop()
    return "".join(c for c, _ in out), [at for _, at in out]


def test_folding_is_that_of_single_characters():
    rng = random.Random(11)
    for raw in ["", " ", "-", "a-\n-\nb", "-\nb", *["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(1500)]]:
        want, at = walked(raw)
        got, places = text.fold_with_map(raw)
        assert (got, places.tolist()) == (want, at) and text.fold(raw) == want, repr(raw)


def test_quotes_are_found_at_their_raw_places(spark):
    docs = [(1, "Intro. The eﬃcient  com-\nbustion of\tFLAMES in Straße 5. The efficient combustion of flames in strasse 5."), (2, "nothing of it"), (3, None), (4, ""), (None, "efficient COMBUSTION of flames")]
    items = [(7, "efficient combustion of flames"), (8, "eﬃcient COMBUS-\ntion  of flames in STRASSE 5"), (9, "flames"), (10, None), (11, "not to be found in any of them")]
    rows = quotes.raw_places(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    raw = dict(docs)
    found = sorted((r["item_id"], r["doc_id"] or 0, raw[r["doc_id"]][r["start"] : r["end"]]) for r in rows)
    assert found == sorted([
        (7, 0, "efficient COMBUSTION of flames"), (7, 1, "eﬃcient  com-\nbustion of\tFLAMES"), (7, 1, "efficient combustion of flames"),
        (8, 1, "eﬃcient  com-\nbustion of\tFLAMES in Straße 5"), (8, 1, "efficient combustion of flames in strasse 5"),
    ])
