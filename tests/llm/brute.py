"""Plain statements of what the operators return, and awkward documents."""

import hashlib
import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PUNCT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def documents(spark, n=60, seed=5):
    """Rows with null, empty and long texts, copies, shared passages, ties, and columns whose names clash."""
    r = random.Random(seed)
    vocabulary = ["de", "été", "Über", "a", "It's", "x1", "naïve", "日本", "the", "of", "longerword" * 3] + ["w%d" % i for i in range(400)]
    some = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = some(60)
    texts = [None, "", " \n\t ", "one", "Two Words", some(3000), passage, some(20) + "\n" + passage + " " + some(30), "a " * 500, "same line\n" * 40]
    while len(texts) < n:
        k = r.random()
        texts.append(r.choice(texts) if k < 0.2 else some(r.randint(5, 30)) + " " + passage[: r.randint(60, 300)] + " " + some(r.randint(1, 30)) if k < 0.5 else some(r.randint(1, 200)))
    rows = [(i * 3, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_words int, component_id string"), [(x[0], x[1]) for x in rows]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
