"""Documents with every awkward case, and plain versions to compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators and stages use inside.
INSIDE = ["_grade", "_kept", "_p", "_d", "_s", "_u", "_copy", "_copies", "_rows", "_t", "_stays", "_lines", "_places", "_k_id", "_k_tie",
          "_gone", "_left", "_text", "_id", "further", "f0"]
CLASHES = ["size", "n", "tie", "line", "place", "root", "node", "key", "row", "k1", "task", "u", "c", "s", "t", "w", "block", "base", "group"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows(texts, ids=None, sources=None, langs=None):
    """Rows of ``documents`` with further columns that bear names the operators use inside."""
    out = []
    for i, t in enumerate(texts):
        out.append((i if ids is None else ids[i], t, "en" if langs is None else langs[i],
                    f"src{i % 3}" if sources is None else sources[i], None if t is None else len(t), *["x"] * len(CLASHES)))
    return out


def frame(spark, *args, **kw):
    return spark.createDataFrame(rows(*args, **kw), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LONG = " ".join(f"word{i % 997} tail{i % 13}." for i in range(30_000))
ODD = [None, "", "   \n\t ", "one", "One two THREE four five six", "One two THREE four five six", "É à ü 漢字 🙂 <|endoftext|> Σας",
       "x" * 5000, LONG, LONG]
