from aula.operators import answers as an

COLUMNS = "id string, lecture_id string, start_timestamp double, end_timestamp double, slide_titles array<string>, clean_text string, cleaned_text string, slide_description string, text string"


def prompt(spark, *chunks):
    results = spark.createDataFrame([(1, c[0], i + 1) for i, c in enumerate(chunks)], "qid bigint, id string, rank int")
    questions = spark.createDataFrame([(1, "why?")], "qid bigint, question string")
    return an.prompts(results, spark.createDataFrame(list(chunks), COLUMNS), questions).collect()[0].prompt


def test_prompts_hold_whole_texts(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(400))
    whole = prompt(spark, ("c", "a", 0.0, 9.0, ["T"], " \n", long("slide"), long("picture"), f" {long('speech')}\n"))
    assert whole == f"Question: why?\n\nExcerpts:\n\n[1] a, 0:00 - 0:09\nSlide titles: T\nSlide text:\n{long('slide')}\nDiagram or code on the slides:\n{long('picture')}\nSpeech:\n{long('speech')}"


def test_passages_without_a_time_stay(spark):
    got = prompt(spark, ("c", "a", 0.0, 9.0, ["T"], "", "", "", "one"), ("d", "a", 5.0, None, [], "", "", "", "two"), ("e", "a", None, None, [], "", "", "", "three"))
    assert "[2] a, 0:05 - -:--\nSpeech:\ntwo" in got and "[3] a, -:-- - -:--\nSpeech:\nthree" in got
