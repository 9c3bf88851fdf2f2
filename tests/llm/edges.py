"""A small table with every awkward case, under columns whose names operators also use."""

LONG = "word " * 30_000 + "x" * 20_000

TEXTS = [
    None, "", " \t\n", "a", "one two", "The quick brown fox jumps over the lazy dog again and again",
    "THE quick brown fox jumps over the lazy dog again and again", LONG, LONG, "12 345 !!", "Ünïcode 中文 🙂 text", "\x00\x01 ctl",
    'token = "0123456789abcdef0123456789abcdef01234567" end', "mail a.b@c.example.org or +1 (555) 010-9999 now",
    "All rights reserved. CC BY 4.0 GNU General Public License",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, h string, fp string, label string, key string, words string, row string"


def edge_docs(spark, repeat=True):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "é"][i % 4], len(t or ""), 1, 2, "h", "f", "l", "k", "w", "r") for i, t in enumerate(TEXTS)]
    if repeat:
        rows += [rows[5], rows[5], (None, "null id text here", "en", "a", 3, 1, 2, "h", "f", "l", "k", "w", "r"), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
