import random

from engramlake.llm import subjects

NOUNS = {
    "law": {"en": ["court", "clause", "witness"], "de": ["Klageschrift", "Vollmacht", "Mietvertrag"], "es": ["contrato", "testigo", "juicio"]},
    "gardening": {"en": ["soil", "harvest", "seeds"], "de": ["Hochbeet", "Komposthaufen", "Saatschale"], "es": ["riego", "poda", "vivero"]},
    "finance": {"en": ["loan", "budget", "savings"], "de": ["Sparkonto", "Kreditzins", "Rentenfonds"], "es": ["hipoteca", "presupuesto", "tesorería"]},
}
SAY = {"en": "they said the {} and the {} from {} were good.", "de": "danach ging es um {} und auch um {} aus {} seit Wochen.", "es": "la persona habló de {} y luego de {} en {} según la nota."}


def test_subjects_without_labels_in_a_language(spark):
    """Only law has labelled German documents, and nothing has Spanish ones; all subjects come out all the same."""
    r = random.Random(3)
    docs, labels, truth = [], [], set()
    for d in range(360):
        lang, s = ("en", "de", "es")[d % 3], r.choice(list(NOUNS))
        name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)).title()
        docs.append((d, " ".join(SAY[lang].format(*r.sample(NOUNS[s][lang], 2), name()) for _ in range(6))))
        truth.add((d, s))
        if d < 120 and (lang == "en" or lang == "de" and s == "law"):
            labels.append((d, s))
    areas = [("law", "courts and contracts"), ("gardening", "plants, soil and harvests"), ("finance", "money and savings")]
    got = subjects.found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame(areas, "subject string, description string"))
    got = {tuple(x) for x in got.collect()}
    for k, lang in enumerate(("en", "de", "es")):
        want, have = {x for x in truth if x[0] % 3 == k}, {x for x in got if x[0] % 3 == k}
        assert len(want & have) / len(want) > 0.95 and len(want & have) / len(have) > 0.95, lang
