"""Small documents with every awkward case, and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, text_key string, row int, _bit int, n long"


def rows(texts, ids=None, sources=None):
    """Rows with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    return [(i, t, "en", s, None if t is None else len(t), "x", "y", 1, 2, 3) for i, t, s in zip(ids, texts, sources)]


def awkward(seed=1, docs=60):
    """Texts with shared passages, copies, near copies, empty and null texts, and repeated rows."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["ä", "é€", "x" * 40, "日本", "🙂", "a|b", "#"]
    passages = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(4)]
    texts, ids = [], []
    for i in range(docs):
        parts = []
        for _ in range(draw.randrange(4)):
            parts.append(draw.choice(passages) if draw.random() < 0.5 else
                         draw.choice([" ", "\n", "\t "]).join(draw.choice(words) for _ in range(draw.randrange(1, 30))))
        texts.append(draw.choice([" ", "\n"]).join(parts))
        ids.append(i * 3)
    full = next(i for i, t in enumerate(texts) if len(t.split()) > 50)
    texts += [None, "", "   \n", texts[full], texts[full] + " ", texts[5], passages[0] * 30]
    ids += [1000, 1001, 1002, 1003, 1004, ids[5], None]
    return rows(texts, ids)


def removed_windows(units_of, docs, length, same_document):
    """For each document, in order of (id, text), which units a window found earlier covers."""
    seen, out = {}, {}
    for key in sorted({(-1 if d is None else d, t or "") for d, t in docs}):
        units = units_of(key[1])
        gone = [False] * len(units)
        fresh = {}
        for i in range(len(units) - length + 1):
            window = tuple(units[i:i + length])
            first = seen.get(window)
            if first is not None and (same_document or first < key[0]):
                for k in range(i, i + length):
                    gone[k] = True
            else:
                fresh.setdefault(window, key[0])
                if same_document:
                    seen.setdefault(window, key[0])
        for window, d in fresh.items():
            seen.setdefault(window, d)
        out[key] = gone
    return out
