"""Clean lines in scripts without case or with other punctuation fail no rule."""

from tallygrid.llm import line_rules

LINES = {
    "ko": "유엔은 오늘 새로운 보고서를 발표했다고 UN 대변인이 서울에서 말했다.",
    "ar": "هل قالت الأمم المتحدة UN إن الناس في القرية يتذكرون الجسر القديم الذي جرفه الفيضان قبل سنوات كثيرة من الآن؟",
    "he": "דובר האו״ם UN אמר היום כי הדוח החדש יפורסם בשבוע הבא בירושלים.",
    "hi": "संयुक्त राष्ट्र UN के प्रवक्ता ने आज कहा कि गाँव के लोग पुराने पुल को याद करते हैं और बाढ़ की कहानी सुनाते हैं जो बहुत पहले आई थी।",
    "zh": "村里的人都记得那座老桥和很多年前把它冲走的洪水" * 5 + "。",
    "ja": "村の人々は古い橋とそれを流した洪水のことを今でもよく覚えている" * 4 + "。",
    "th": "ชาวบ้านยังจำสะพานเก่าและน้ำท่วมที่พัดมันไปเมื่อหลายปีก่อนได้ดีและเล่าให้ลูกหลานฟังทุกครั้งที่ฝนตกหนักในหมู่บ้าน" * 2,
}
BAD = {"loud": "THE RIVER RUNS PAST THE OLD MILL.", "endless": "the river runs past the old mill and " * 4}


def test_clean_lines_of_all_scripts(spark):
    frame = spark.createDataFrame([(k, v) for k, v in {**LINES, **BAD}.items()], "name string, line string")
    failed = {r.name for r in frame.filter(line_rules.fails(frame["line"])).collect()}
    assert failed == set(BAD)


def test_sql_and_code_agree_on_all_scripts(spark, tmp_path):
    import duckdb

    from tallygrid.llm.oracles import oracle_sql

    texts = [line for line in {**LINES, **BAD}.values()]
    texts += ["\n".join([*texts[:4], " ".join(f"w{i}" for i in range(80)) + "."]), "\n".join(texts[4:]) + " " + "wort " * 60 + "."]
    texts += [f"{texts[0]}\n{BAD['loud']}\nUN NATO EU 유엔은 오늘 새로운 보고서를\n" + " ".join(f"v{i}" for i in range(70)) + "."]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = ["doc_id", "n_words", "word_chars", "lost_chars", "base_failed", "kept"]
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op9_line_rules']})").fetchall()
    found = line_rules.digest(spark.read.parquet(path)).select(*columns).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert {r.kept for r in found} == {True, False} and any(r.lost_chars for r in found)
