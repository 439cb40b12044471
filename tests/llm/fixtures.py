"""Small documents with every odd case, and columns whose names the operators use inside."""

import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, id string, key string, "
    "part string, slot string, shard string, around string, doc string, size string, epoch string, label string, l string"
)
SHARED = "the committee agreed on the following statement after a long debate, and it was printed in full: "
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    long = " ".join(f"w{i}" for i in range(30_000))
    near = PROSE.split()
    return [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),  # exact copy
        (2, PROSE, "en", "a"),  # repeated row
        (3, PROSE.upper(), "en", None),
        (4, " ".join([*near[:-1], "end"]), "en", "b"),  # near copy
        (5, None, "en", "b"),
        (6, "", "de", "b"),
        (7, " \t\n ", None, "c"),
        (8, "one", "de", "c"),
        (9, "one", None, "c"),
        (10, "one two", "de", "c"),
        (11, SHARED + "nothing else of note", "en", "a"),
        (12, "before this, " + SHARED + "there was silence", "en", "a"),
        (13, "ñandú café " * 30, "es", "d"),
        (14, "ñandú café " * 30 + "x", "es", "d"),
        (15, long, "en", "hot"),
        (16, long + " tail", "en", "hot"),
        (17, "aaaa" * 500, "en", "hot"),
        (18, "日本語のテキスト です", "ja", "hot"),
        (19, "line one here\nline one here\nline two here\nline one here", "en", "hot"),
        (20, "### $$$ %%% 123 456", "en", "hot"),
        (21, "<|endoftext|> it's  two\n\n spaces wide \x1c sep <|endoftext|>", "en", "hot"),
        (None, PROSE + " " + SHARED, "en", "hot"),
        (22, "привет мир это русский текст и ещё слова", "ru", "hot"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, lang, s, None if t is None else len(t), *["clash"] * 12) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")
