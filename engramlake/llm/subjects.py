"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization.

The unit is the sentence, since a document has a subject if at least ``SHARE`` of its sentences
are about it. A sentence is about one subject or about none (talk about remembering and the
conversation itself). Words are hashed into a fixed number of buckets, so counts have one size
whatever the vocabulary, and only those counts (buckets x classes) reach the driver.

1. First counts: sentences of labelled documents, spread over the document's labels, or none where a seed
   word of none stands, plus the words of the subjects' descriptions and the seed words. In languages other than
   the first, where labels may be missing, sentences with a seed word of a subject start it, labelled or not.
2. Expectation: complement naive Bayes scores and the document's own mix give each sentence a posterior
   over the classes; a labelled document's listed subjects weigh more, as its list may be incomplete.
   Maximization: new counts from all documents, labelled or not. A fixed number of rounds.
3. Each subject's posterior for a document is the chance that enough of its sentences are about it,
   sentences taken as independent, with one temperature calibrated on labelled documents that are kept from the fit.

Defined results: null and blank texts, and texts without a sentence, have no subject; language does not
matter; labels for unknown documents or subjects are ignored; rows that repeat an id count once each in
the counts and once in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from engramlake.llm.text import WORD
from engramlake.runtime import cut

SHARE = 0.2
#: Buckets of one language; a sentence's words fall into those of its own language.
BUCKETS = 1 << 16
#: The most frequent function words of each language; a sentence without any counts as the first.
LANGUAGES = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by but not what all were we when your can said there an which do their if will".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también".split(),
}
TOTAL = BUCKETS * len(LANGUAGES)
ROUNDS = 4
SMOOTHING = 0.3
#: How much less a labelled document's unlisted subjects weigh than its listed ones.
UNLISTED = 0.1
#: A class with less than this share of the mean class counts for less than the others.
EVEN = 0.05
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
#: One labelled document in so many is kept from the fit and sets the temperature.
HELD_OUT = 5
#: The words by which the problem itself says what has no subject (remembering, reminders, the conversation), in three languages.
NONE_WORDS = {
    "en": "remember remembers remembered remembering reminder reminders conversation conversations".split(),
    "de": "erinnern erinnert erinnerung erinnerungen gespräch unterhaltung".split(),
    "es": "recordar recuerda recordatorio recordatorios conversación".split(),
}
#: Expected counts are kept in this many parts of one.
UNIT = 4096
NONE_COUNT, DESCRIPTION_COUNT = 40, 10
#: Words that start a subject in the other languages, where no labelled document may have it; general vocabulary.
SUBJECT_WORDS = {
    "cooking": {
        "de": "rezept rezepte kochen küche backen backofen backblech braten topf pfanne suppe linsensuppe teig sauerteig gewürz gewürze gewürzregal kräuter zutaten mehl zwiebel zwiebeln knoblauch butter soße gericht mahlzeit",
        "es": "cocina cocinar recetas horno sartén olla salsa sopa caldo guiso ingredientes harina cebolla ajo lentejas pollo arroz plato hornear freír especias comida",
    },
    "finance": {
        "de": "geld steuer steuern steuererklärung konto sparkonto girokonto kredit kreditzins zinsen rechnung haushaltsplan budget sparen ersparnisse aktie aktien fonds darlehen hypothek rente bank überweisung",
        "es": "dinero hipoteca ahorro ahorros presupuesto impuesto impuestos factura interés préstamo préstamos crédito banco inversión acciones bolsa deuda pensión",
    },
    "gardening": {
        "de": "garten gärtner pflanze pflanzen beet beete hochbeet gemüsebeet obstbaum obstbäume kompost komposthaufen rose rosen hecke rosenhecke rasen samen saatgut aussaat erde dünger unkraut schnecken ernte blumen gießkanne regentonne",
        "es": "jardín jardinería planta plantas huerto semilla semillas maceta macetas riego regar poda podar abono compost césped tierra flores rosal rosales cosecha plaga plagas invernadero",
    },
    "health": {
        "de": "arzt hausarzt ärztin krankheit symptome allergie allergietest blutdruck impfung impfpass schlaf schlafmangel physiotherapie therapie medizin medikament medikamente schmerzen fieber krankenhaus genesung",
        "es": "médico médica salud enfermedad síntomas alergia vacuna vacunas presión arterial dolor fisioterapia medicina medicamento fiebre hospital tratamiento sueño",
    },
    "law": {
        "de": "gericht gerichtstermin recht gesetz vertrag mietvertrag anwalt anwältin klage klageschrift berufung urteil richter zeuge zeugenaussage vollmacht paragraf strafe notar",
        "es": "ley leyes juicio juez jueza tribunal contrato cláusula abogado abogada demanda apelación testigo testigos notario sentencia derecho derechos",
    },
    "music": {
        "de": "musik klavier klavierabend gitarre geige chor chorprobe orchester konzert lied lieder noten notenblatt takt melodie streichquartett komponist aufnahme schlagzeug",
        "es": "música guitarra piano violín coro orquesta concierto canción canciones partitura compás melodía recital tambor grabación compositor",
    },
    "science": {
        "de": "forschung experiment experimente versuch versuchsaufbau hypothese labor laborprobe messung messreihe mikroskop teleskop teilchen zelle zellen zellkultur physik chemie biologie theorie",
        "es": "ciencia investigación experimento experimentos hipótesis laboratorio microscopio telescopio medición espectro célula células celular física química biología",
    },
    "software": {
        "de": "programm programme programmieren quelltext code fehlerbericht speicherfehler datenbank datenbankindex testlauf server compiler entwickler version versionszweig schnittstelle absturz",
        "es": "programa programas programar código servidor compilador errores datos versiones pruebas depurar desarrollador interfaz",
    },
    "sport": {
        "de": "sport training trainingsplan trainer mannschaft spiel heimspiel tor torwart schiedsrichter wettkampf lauf marathon halbmarathon staffellauf liga turnier fußball",
        "es": "deporte entrenamiento entrenador equipo partido portero árbitro carrera maratón liga torneo gol fútbol atleta salto",
    },
    "travel": {
        "de": "reise reisen zug nachtzug flug flughafen hafen fährhafen gepäck gepäckschein koffer hotel unterkunft grenze zwischenstopp fensterplatz berghütte fahrkarte bahnhof",
        "es": "viaje viajes viajar tren vuelo aeropuerto equipaje maleta hotel albergue frontera embarque pasaporte reserva estación billete",
    },
}

#: What stands before a line's text: the handle and label of a listed memory, or up to three words and a colon, bar or bracket.
_LEAD = re.compile(r"^\W*(?:M\d+\W*\([^)]*\)|\w+(?:[ \t]+\w+){0,2}[ \t]*[|:>)][ \t]*)?\W*")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?<=[.!?…])[\"”’*_)]*\s+")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence: lines without their marks, split after stops; under four words is no sentence."""
    out = []
    for line in text.splitlines():
        body = line[_LEAD.match(line).end() :].lower()
        if body:
            for s in _END.split(body):
                if len(ws := _LETTERS.findall(s)) >= 4:
                    out.append(ws)
    return out


def bucket(vocab: list[str]) -> np.ndarray:
    """A word's bucket within its language."""
    return (pd.util.hash_array(np.array(vocab, dtype=object), categorize=False) % BUCKETS).astype(np.int32) if vocab else np.zeros(0, np.int32)


def languages(vocab: list[str], coded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each sentence (starting at first) the language whose tell-tale words are the most, the first if several."""
    tells = np.array([[w in ws for ws in _TELLS] for w in vocab], np.int16)
    return np.add.reduceat(tells[coded], first, axis=0).argmax(1).astype(np.int32)


_TELLS = [frozenset(ws) for ws in LANGUAGES.values()]


def starters(subjects: list[tuple[str, str | None]]) -> np.ndarray:
    """For each bucket the number of the subject whose seed word it holds, -1 if none; the first language has none."""
    out = np.full(TOTAL, -1, np.int16)
    several = set()
    for k, (name, description) in enumerate(subjects):
        own = [w for w in WORD.findall(f"{name} {description or ''}".lower()) if len(w) > 3]
        for at, language in list(enumerate(LANGUAGES))[1:]:
            for b in bucket(sorted({*own, *SUBJECT_WORDS.get(name.lower(), {}).get(language, "").split()})) + at * BUCKETS:
                if out[b] >= 0:
                    several.add(b)
                out[b] = k
    out[list(several)] = -1  # a word of several subjects tells nothing
    return out


def hashed(documents: DataFrame, labels: DataFrame, areas: list[tuple[str, str | None]], doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words (buckets), lens (words a sentence), starts (has a seed word), labels (numbers of subjects, null if unlabelled), held (labels kept from the fit)."""
    subjects = [s for s, _ in areas]
    number = F.create_map(*[x for k, s in enumerate(subjects) for x in (F.lit(s), F.lit(k))])
    given = labels.where(F.col("subject").isin(subjects)).select(F.col("doc_id").alias("l_id"), number[F.col("subject")].alias("k")).groupBy("l_id").agg(F.array_sort(F.collect_set("k")).alias("labels"))
    key_type = dict(documents.dtypes)[doc_id]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = starters(areas)
        for b in batches:
            if not len(b):
                continue
            found = [sentences(t) for t in b["text"]]
            flat = [w for doc in found for s in doc for w in s]
            if flat:
                coded = pa.array(flat, pa.string()).dictionary_encode()
                vocab, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                size = np.fromiter((len(s) for doc in found for s in doc), np.int64)
                tongue = languages(vocab, codes, np.concatenate([[0], np.cumsum(size)[:-1]]))
                ids = bucket(vocab)[codes] + BUCKETS * np.repeat(tongue, size)
            else:
                ids = np.zeros(0, np.int32)
            ends = np.cumsum([sum(map(len, doc)) for doc in found])
            told = np.diff(np.concatenate([[0], np.cumsum(table[ids] >= 0)])[np.concatenate([[0], ends])]) > 0
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "starts": told, "words": np.split(ids, ends[:-1]) if len(ends) else [], "lens": [np.array(list(map(len, doc)), np.int32) for doc in found]})

    texts = documents.where(F.col(text_col).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    words = texts.mapInPandas(split, f"doc_id {key_type}, starts boolean, words array<int>, lens array<int>")
    joined = words.where("size(lens) > 0").join(given, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    held = F.col("labels").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    return cut(joined.withColumn("held", F.when(held, F.col("labels"))).withColumn("labels", F.when(~held, F.col("labels"))))


class Model:
    """Complement naive Bayes over buckets; the last class is 'none'."""

    def __init__(self, counts: np.ndarray) -> None:
        # Classes weigh the same within a language, so that words all its sentences share tell nothing.
        by = counts.reshape(len(LANGUAGES), BUCKETS, -1)
        size = by.sum(1, keepdims=True)
        mean = size.mean(2, keepdims=True)
        even = by * (mean / (size + EVEN * mean + 1e-9))
        rest = even.sum(2, keepdims=True) - even
        log = np.log(rest + SMOOTHING) - np.log(rest.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        log -= log.mean(2, keepdims=True)
        log[by.sum(2) < 1] = 0
        self.weights = -log.reshape(TOTAL, -1).astype(np.float32)
        # A subject without a word in a language can't be told there.
        self.known = (size[:, 0] >= 1).astype(np.float32)
        self.known[:, -1] = 1

    def posterior(self, words: np.ndarray, lens: np.ndarray, doc: np.ndarray, allowed: np.ndarray | None, temperature: float = 1.0) -> np.ndarray:
        """Per sentence; doc numbers its document, allowed weighs classes per document."""
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        score = np.add.reduceat(self.weights[words], first, axis=0) / temperature
        known = self.known[words[first] // BUCKETS]
        score -= 1e6 * (1 - known)
        like = np.exp(score - score.max(1, keepdims=True)) * known + 1e-30
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.concatenate([start, [len(doc)]]))
        mix = np.full((len(start), like.shape[1]), 1.0 / like.shape[1], np.float32)
        at = np.repeat(np.arange(len(start)), size)
        for _ in range(3):
            p = like * mix[at]
            if allowed is not None:
                p *= allowed[at]
            p /= p.sum(1, keepdims=True)
            mix = (np.add.reduceat(p, start, axis=0) + 0.5) / (size[:, None] + 0.5 * like.shape[1])
        return p


def _flat(b: pd.DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, lens, document of each sentence, allowed classes, is labelled) of a batch."""
    words, lens = np.concatenate(list(b["words"])), np.concatenate(list(b["lens"]))
    doc = np.repeat(np.arange(len(b)), [len(x) for x in b["lens"]])
    allowed, known = np.ones((len(b), classes), np.float32), np.zeros(len(b), bool)
    for k, given in enumerate(b["labels"]):
        if given is not None and len(given):
            allowed[k, :-1] = UNLISTED
            allowed[k, np.asarray(given)] = 1
            known[k] = True
    return words, lens, doc, allowed, known


def _counts(features: DataFrame, model: Model | None, classes: int, areas: list[tuple[str, str | None]] | None = None) -> np.ndarray:
    """Expected words of each class, summed over all rows (buckets x classes numbers reach the driver)."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    tells = np.concatenate([bucket(ws) + k * BUCKETS for k, ws in enumerate(NONE_WORDS.values())])

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((TOTAL, classes))
        table = starters(areas) if shared.value is None else None
        for b in batches:
            if not len(b):
                continue
            words, lens, doc, allowed, known = _flat(b, classes)
            if shared.value is None:  # seed words, else the labels of labelled documents, or none where a word tells so
                p = np.where((allowed == 1) & known[:, None], 1.0, 0.0)
                p[:, -1] = 0
                p = (p / np.maximum(p.sum(1, keepdims=True), 1))[doc]
                told = np.zeros_like(p)
                at = np.flatnonzero(table[words] >= 0)
                np.add.at(told, (np.repeat(np.arange(len(lens)), lens)[at], table[words[at]]), 1)
                seeded = told.sum(1) > 0
                p[seeded] = told[seeded] / told[seeded].sum(1, keepdims=True)
                none = np.add.reduceat(np.isin(words, tells), np.concatenate([[0], np.cumsum(lens)[:-1]]))[:, None] > 0
                p = np.where(none, 0.1, 0.9) * p
                p[:, -1:] = np.where(none, 0.9, 0.1) * (none | (seeded | known[doc])[:, None])
            else:
                p = shared.value.posterior(words, lens, doc, allowed)
            p = np.round(p * UNIT)  # whole numbers add up alike in any order
            of = np.repeat(np.arange(len(lens)), lens)
            for c in range(classes):
                total[:, c] += np.bincount(words, weights=p[:, c][of], minlength=TOTAL)
        used = np.flatnonzero(total.sum(1))
        yield pd.DataFrame({"bucket": used.astype(np.int32)} | {f"n{c}": total[used, c].astype(np.int64) for c in range(classes)})

    summed = (
        features.select("words", "lens", "labels")
        .mapInPandas(expect, "bucket int, " + ", ".join(f"n{c} bigint" for c in range(classes)))
        .groupBy("bucket")
        .agg(*((F.sum(f"n{c}") / UNIT).cast("float").alias(f"n{c}") for c in range(classes)))
    )
    got = summed.toPandas()
    out = np.zeros((TOTAL, classes))
    out[got["bucket"].to_numpy()] = got[[f"n{c}" for c in range(classes)]].to_numpy()
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return np.where(x >= 0, (1 + erf) / 2, (1 - erf) / 2)


def document_posteriors(p: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Chance that at least SHARE of a document's sentences are about each subject."""
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    n = np.diff(np.concatenate([start, [len(doc)]]))
    mean = np.add.reduceat(p, start, axis=0)[:, :-1]
    var = np.add.reduceat(p * (1 - p), start, axis=0)[:, :-1]
    need = np.ceil(SHARE * n - 1e-9)[:, None]
    return _normal((mean - need + 0.5) / np.sqrt(var + 1e-4))


def _temperature(labelled: DataFrame, model: Model, classes: int) -> float:
    """The temperature with the least squared error on labelled documents that the fit has not seen (a handful of sums reach the driver)."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            words, lens, doc, allowed, _ = _flat(b, classes)
            given = allowed[:, :-1] == 1
            for k, t in enumerate(TEMPERATURES):
                q = document_posteriors(shared.value.posterior(words, lens, doc, None, t), doc)
                yield pd.DataFrame({"k": [k], "e": [float(((q - given) ** 2).sum())]})

    sums = {r["k"]: r["e"] for r in labelled.select("words", "lens", "labels").mapInPandas(errors, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()}
    return TEMPERATURES[min(sums, key=lambda k: (round(sums[k], 6), k))] if sums else 1.0


def fit(features: DataFrame, subjects: list[tuple[str, str]], rounds: int = ROUNDS) -> tuple[Model, float]:
    """The model and its temperature (runs one job a round)."""
    classes = len(subjects) + 1
    seeds = np.zeros((TOTAL, classes))
    for k, (name, description) in enumerate(subjects):
        for w in WORD.findall(f"{name} {description or ''}".lower()):
            if len(w) > 3:
                seeds[bucket([w])[0], k] += DESCRIPTION_COUNT
    table = starters(subjects)
    told = np.flatnonzero(table >= 0)
    seeds[told, table[told]] += DESCRIPTION_COUNT
    for k, ws in enumerate(NONE_WORDS.values()):
        for w in ws:
            seeds[bucket([w])[0] + k * BUCKETS, -1] += NONE_COUNT
    held, begun = features.where("held is not null").select("words", "lens", F.col("held").alias("labels")), features.where("labels is not null or starts")
    model = Model(_counts(begun, None, classes, subjects) + seeds)
    model = Model(_counts(begun, model, classes) + seeds)
    for _ in range(rounds - 1):
        model = Model(_counts(features, model, classes) + seeds)
    return model, _temperature(held, model, classes)


def posteriors(documents: DataFrame, labels: DataFrame, subject_area: DataFrame, doc_id: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, subject, posterior, share for every document and subject with a posterior over 0.01."""
    subjects = [(r["subject"], r["description"]) for r in subject_area.where("subject is not null").groupBy("subject").agg(F.min("description").alias("description")).orderBy("subject").collect()]
    names = [s for s, _ in subjects]
    features = hashed(documents, labels, subjects, doc_id, text_col)
    model, temperature = fit(features, subjects, rounds)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key_type = dict(features.dtypes)["doc_id"]
    classes = len(names) + 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            words, lens, doc, _, _ = _flat(b, classes)
            p = shared.value.posterior(words, lens, doc, None, temperature)
            q = document_posteriors(p, doc)
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            share = np.add.reduceat(p, start, axis=0)[:, :-1] / np.bincount(doc)[:, None]
            row, col = np.nonzero(q > 0.01)
            if len(row):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[row], "subject": [names[c] for c in col], "posterior": q[row, col].astype(float), "share": share[row, col].astype(float)})

    return features.select("doc_id", "words", "lens", "labels").mapInPandas(assign, f"doc_id {key_type}, subject string, posterior double, share double")


def found(documents: DataFrame, labels: DataFrame, subject_area: DataFrame) -> DataFrame:
    """doc_id, subject where the posterior is at least one half."""
    return posteriors(documents, labels, subject_area).where("posterior >= 0.5").select("doc_id", "subject").distinct()
