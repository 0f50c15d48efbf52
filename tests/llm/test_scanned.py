import random

import pandas as pd
from tesserakit.llm import scanned as S

WORDS = "the morning station carries every passenger through another tunnel before winter mountain weather closes modern bridges along northern rivers".split()


def book(rng, pages=4):
    """A printed file's paragraphs and what a scan makes of them, with the lines' kinds of damage."""
    lines, damage, paragraphs = [], [], []
    for p in range(1, pages + 1):
        lines += [f"[PAGE {p}]", f"Journal of rivers KL-482    {p + 30}", ""]
        damage += [set(), {"running"}, set()]
        for _ in range(3):
            words = [rng.choice(WORDS) for _ in range(rng.randint(40, 60))]
            words[0], words[-1] = words[0].capitalize(), words[-1] + "."
            paragraphs.append(" ".join(words))
            row, rows = "", []
            for w in words:
                if len(row) + len(w) + 1 > 60:
                    cut = 60 - len(row) - 2
                    if 3 <= cut <= len(w) - 3 and w.isalpha() and rng.random() < 0.5:
                        rows.append((f"{row} {w[:cut]}-", {"broken"}))
                        row = w[cut:]
                        continue
                    rows.append((row, set()))
                    row = ""
                row = f"{row} {w}".strip()
            rows.append((row, set()))
            for text, kinds in rows:
                if rng.random() < 0.15 and " tunnel " in text:
                    text, kinds = text.replace(" tunnel ", " tunne1 "), kinds | {"misread"}
                elif rng.random() < 0.15 and " modern " in text:
                    text, kinds = text.replace(" modern ", " modem "), kinds | {"misread"}
                lines.append(text)
                damage.append(kinds)
            lines.append("")
            damage.append(set())
        lines.append(f"- {p} -")
        damage.append({"running"})
    return "\n".join(lines), damage, paragraphs


def vocabulary():
    counts = dict.fromkeys(WORDS, 50)
    return S.Vocabulary(counts | {"double-checked": 5, "double": 3, "checked": 3})


def test_held_out_files():
    rng = random.Random(4)
    model = S.train([(book(rng)[0], "Journal of rivers KL-482") for _ in range(20)])
    hit = found = real = 0
    for _ in range(10):
        text, damage, paragraphs = book(rng)
        got = S.repair(text, "Journal of rivers KL-482", model, vocabulary())
        a = {(k, d) for k, s in enumerate(got.damage) for d in s}
        b = {(k, d) for k, s in enumerate(damage) for d in s}
        hit, found, real = hit + len(a & b), found + len(a), real + len(b)
        assert sum(p in got.paragraphs for p in paragraphs) >= 0.8 * len(paragraphs)
    assert hit / found > 0.97 and hit / real > 0.97


def test_hyphens():
    v = vocabulary()
    assert S._compound("double", "checked", v) and not S._compound("tun", "nel", v) and S._compound("KD", "8593", v) and not S._compound("Grok", "edar", v)


def test_words():
    v = vocabulary()
    for token, (bad, right) in {"tunnel,": (False, None), "tunne1": (True, "tunnel"), "everypassenger": (True, "every passenger"), "WM-2298": (False, None), "1,234.5": (False, None), "Grokedar": (False, None), "a.tar.gz": (False, None), "—": (False, None)}.items():
        assert S.odd(token, v) == (bad, right), token


def test_page_numbers():
    assert [S.page_number(t) for t in ("- 4 -", "[70]", "[72|", "p. 37", "Page 1 of 4", "l53", "   xiv", "No – depot", "2323 rows")] == [4, 70, 72, 37, 1, 153, 14, None, None]


def test_table(spark):
    text = book(random.Random(1))[0]
    rows = [("a", text, None, 1), ("a", text, None, 2), ("n", None, "t", 3), ("e", "", "t", 4), (None, text, "t", 5), ("one", "only a line", "t", 6)]
    scans = spark.createDataFrame(rows, "source_path string, text string, title string, line_no int")
    clean = spark.createDataFrame([(" ".join(WORDS),)] * 5 + [(None,), ("",)], "text string")
    lexicon = spark.createDataFrame([("Tunnel", "en"), (None, "en")], "word string, lang string")
    found = S.find_damage(scans, clean, lexicon).collect()
    assert {r["source_path"] for r in found} >= {"a"} and len(found) == len(set(map(tuple, found)))
    assert {r["source_path"] for r in S.repair_scans(scans, clean).collect()} == {"a", "one"}
    assert S.find_damage(scans.limit(0), clean).count() == 0 and S.find_damage(scans, clean.limit(0)).count() >= 1


def test_rare_words_are_known(spark, monkeypatch):
    rng = random.Random(7)
    files = [(f"f{i}", book(rng)[0].replace("passenger", "passcnger", 1).replace("mountain ", "mountainweather ", 1), None) for i in range(6)]
    scans = spark.createDataFrame(files, "source_path string, text string, title string")
    clean = spark.createDataFrame([(" ".join(WORDS) + " double-checked",)] * 3 + [("the the the",)] * 400, "text string")
    found = []
    for least in (1e-9, 0.1):  # all words are common ones; only the commonest is
        monkeypatch.setattr(S, "LEAST", least)
        words = S.vocabulary_of(clean)
        assert len(words.common.counts) == (len(WORDS) + 3 if least < 0.1 else 1)
        found.append(sorted(map(tuple, S.find_damage(scans, clean).collect())) + sorted(map(tuple, S.repair_scans(scans, clean).collect())))
    assert found[0] == found[1] and any(kind == "misread" for _, _, kind in found[0][:200])


def test_questions_meet_their_answers():
    v = S.Vocabulary({"the": 5})
    with v.knowing({"half-way": 2}):
        assert "half-way" in v and v.compounds == {"half": ["way"]}
    assert "half-way" not in v and v.compounds == {}
    keys = next(S._question_keys(iter([pd.DataFrame({"word": ["tunncl"], "place": ["near"]})])))
    own = next(S._word_keys(iter([pd.DataFrame({"word": ["tunnel", "tunnels", "tunne"], "n": [1, 1, 1]})])))
    assert set(own[own.key.isin(keys[~keys.exact].key)].word) == {"tunnel", "tunne"}
