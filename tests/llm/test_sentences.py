import pandas as pd
from tesserakit.llm import sentences as S

EN = S.Model({"dr", "sec", "etc", "corp"}, {("no", "#")}, {"the", "release", "~kbtool-x"}, {"the", "when", "release"})
MODELS = {"en": EN, "de": S.Model({"z", "b"}, {("#", "quartal")}, {"die"}, {"die"}), "hi": S.Model({"डॉ"}), "xx": S.Model()}


def units(text):
    return [text[a:b] for a, b in S.sentences(text, MODELS)]


def test_periods():
    assert units("See Dr. Smith in sec. 4.5 of it. The end. Reads a.md, etc. Release it is No. 5 of 6.") == ["See Dr. Smith in sec. 4.5 of it.", "The end.", "Reads a.md, etc.", "Release it is No. 5 of 6."]
    assert units("“It is late,” wrote S. A. Moor, “and the end.” The end.") == ["“It is late,” wrote S. A. Moor, “and the end.”", "The end."]
    assert units("Im 2. Quartal ist die Zahl da. Die Zahl ist z. B. klein.") == ["Im 2. Quartal ist die Zahl da.", "Die Zahl ist z. B. klein."]
    assert units("It works on it. kbtool-x serve starts.It is lost. At branch.complete.invalid it is.") == ["It works on it.", "kbtool-x serve starts.", "It is lost.", "At branch.complete.invalid it is."]


def test_quotes_and_brackets():
    assert units("'Stop!', the man said. (It was late.) He wrote “No way.” The end.") == ["'Stop!', the man said.", "(It was late.)", "He wrote “No way.”", "The end."]
    assert units("“Is it?” asked the man. Really?! The console said \"Not found.\" The end.") == ["“Is it?” asked the man.", "Really?!", 'The console said "Not found."', "The end."]
    assert units("« La pile est vide ! » signale le bloc. Le bloc est là.") == ["« La pile est vide ! » signale le bloc.", "Le bloc est là."]


def test_scripts():
    assert units("队列停了？！“不存在！”系统提示。他说：「不要。」完成……结束。") == ["队列停了？！", "“不存在！”系统提示。", "他说：「不要。」", "完成……结束。"]
    assert units("「ありません。」と表示。次の文です。") == ["「ありません。」と表示。", "次の文です。"]
    assert units("रिपोर्ट रुकी॥ डॉ. Rao ने खोली। “खाली है!” यह आया।") == ["रिपोर्ट रुकी॥", "डॉ. Rao ने खोली।", "“खाली है!” यह आया।"]
    assert units("เอกสารใหม่ สำเนา 14 รายการ “ว่าง!”เป็นข้อ\nตาราง") == ["เอกสารใหม่", "สำเนา 14 รายการ", "“ว่าง!”เป็นข้อ", "ตาราง"]
    assert units("Γιατί ο κόμβος καθυστερεί; Ο πίνακας είναι εδώ.") == ["Γιατί ο κόμβος καθυστερεί;", "Ο πίνακας είναι εδώ."]


def test_blocks():
    text = "A heading\n\n1. One thing. Two\n2. Other\n\nA line\nbroken here. The next\n2. of it.\n\n- x\n* y\n   \nend"
    assert units(text) == ["A heading", "One thing. Two", "Other", "A line\nbroken here.", "The next\n2. of it.", "x", "y", "end"]
    assert units("") == [] and units(" \n\t\n") == [] and units("...") == ["..."]


def test_learning(spark):
    lines = ["The man met Prof. Smith in the hall.", "The man saw the dog.", "It was the man with the dog.", "When the dog ran the man saw it.", "The day in the hall was with Prof. Jones and the day was it."]
    docs = spark.createDataFrame([(i, lines[i % 5] + " " + lines[(i * 3 + 1) % 5]) for i in range(400)], "doc_id bigint, text string")
    models = S.learn(docs)
    assert models["en"].abbreviations == {"prof"} and "the" in models["en"].starters
    assert "dog" in models["en"].common


def test_starters_after_many_different_words(spark):
    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "wort"

    rows = [(i, f"The {name(i)}. Again the man is in the {name(i + 1000)}.") for i in range(1000)]
    models = S.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert models["en"].starters == {"again"} and not models["en"].abbreviations


def test_table(spark):
    long = "A sentence is here. " * 20_000
    rows = [(1, "One is. The two is.", "x"), (1, "One is. The two is.", "y"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (None, "A.", "x"), (5, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumnRenamed("lang", "start_char")
    got = pd.DataFrame([r.asDict() for r in S.split_sentences(docs, models=MODELS).collect()])
    assert got[got.doc_id == 1][["start_char", "end_char"]].values.tolist() == [[0, 7], [8, 19]]
    assert (got.doc_id == 5).sum() == 20_000 and set(got.doc_id.dropna()) == {1, 5} and got.doc_id.isna().sum() == 1
    assert S.split_sentences(docs.limit(0)).count() == 0


def test_a_language_outside_the_lists(spark):
    it = ["Il dott. Rossi vide il cane nella sala.", "Quando il cane corse via lui lo vide.", "Era il giorno del cane con il dott. Bianchi nella sala.", "Però il giorno era lungo."]
    pl = ["Pies i kot są w domu.", "Kiedy pies biegł to kot spał.", "Dzień był długi a kot był w domu.", "Jest tam pies i nie ma kota."]
    rows = [(i, " ".join((it, pl)[i % 2][(i // 2 + k) % 4] for k in (0, 1, 3)), ("it-IT", "PL", None, "it", "pl_PL", "pl", "it", "pl")[i % 8]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = S.learn(docs, lang="lang")
    assert {"il", "cane"} <= models.profiles["it"] and {"pies", "kot"} <= models.profiles["pl"]
    assert S.language("Il cane era nella sala", models.profiles) == "it" and "dott" in models["it"].abbreviations - models["pl"].abbreviations
    text = "Il dott. Rossi vide il cane. Il giorno era lungo."
    assert [text[a:b] for a, b in S.sentences(text, models)] == ["Il dott. Rossi vide il cane.", "Il giorno era lungo."]
    labels = spark.createDataFrame([(x,) for x in ("EN", " en_US ", "de-XX", "", "12", None)], "l string").select(S.label("l")).collect()
    assert [r[0] for r in labels] == ["en", "en", "de", "", "", None] and S.learn_profiles(docs.limit(0), "lang") == {}


def test_rare_words_decide_behind_abbreviations(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST", 0.5)
    lines = ["He saw the dog, the cat etc. Zebras came.", "All zebras ran and the dog etc. stood.", "The man, the dog etc. saw the cat.", "It was the dog."]
    docs = spark.createDataFrame([(i, lines[i % 4]) for i in range(400)], "doc_id bigint, text string")
    models = S.learn(docs)
    assert "etc" in models["en"].abbreviations and "zebras" in models["en"].common and "ran" not in models["en"].common
