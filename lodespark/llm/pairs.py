"""Broken prompt and response pairs.

A multi-label linear classifier on hashed n-grams and pair features. It is trained here, on answers of the data that
look whole (they are the reference answer, or a full sentence that holds it) and on defects made from them: answers
cut off, questions given back, answers swapped between languages, refusals composed by a grammar of phrases, fillers and
nothing at all. A label's threshold is calibrated on answers kept out of training. The weights are fitted to a bounded
sample of rows (``TRAIN_ROWS``, the rows of the smallest hashes); words are counted over all rows, and every row is judged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.session import cut

#: Rows of which answers for training are taken at most.
TRAIN_ROWS = 6_000
HASHED = 1 << 16
#: A word that the driver holds is one in this many words at least, which bounds how many it holds.
LEXICON_WORDS = 200_000
LABELS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Defects that a reference answer can have.
GOLD_LABELS = ("empty", "copied_question", "other_language")

# Function words and words for yes and no of the languages, fillers, and markers before an answer.
FUNCTION_WORDS = {
    "en": "the of and in to was is were by that with for from who which what when where at as it this not been has had he she his her their they before after under into both are an be does did do how on or no".split(),
    "fr": "le la les de des du et en dans est été par qui que avec pour une un au aux sur ce cette son sa ses à où avant après ne pas il elle nous vous sont ont cela fut quel quelle ont étaient c’est l’a d’".split(),
    "de": "der die das den dem des und in im ist war wurde von vom mit für ein eine einen einer zu zum zur nicht auch bei nach vor aus über wer was wann wo welche welcher welches sie er es beide haben hat sich an auf als".split(),
    "es": "el la los las de del y en es fue por que con para una un al se su sus lo como antes después no está esta este ha han dicen sobre quién qué dónde cuándo cuál ambos eran según".split(),
}
YES_NO = {"en": ("yes", "no"), "fr": ("oui", "non"), "de": ("ja", "nein"), "es": ("sí", "si", "no")}
FILLERS = frozenset("n/a|na|null|none|nil|nan|undefined|tbd|todo|xxx|no answer|not available|not applicable|blank|empty|missing|placeholder|unanswered|k. a.|s. o.".split("|"))
MARKER = re.compile(r"^\s*(?:final[_ ]answer(?:[_ ]text)?|answer|response|a|antwort|réponse|respuesta)\s*[:：]\s*", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_ONLY = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}

# A grammar of refusals by language: rules whose slots are filled from the lists below them (general wording; {n} is a name of the question).
REFUSALS = {
    "en": {
        "rules": (
            "{open}{I} {cannot} {tell} {it}{end}", "{open}{I} {dont} {know} {it}{end}", "{open}{I} {dont} {have} {enough} {info}{end}", "{open}{there} {enough} {info} {within} {text}{end}",
            "{open}{text} {silent} {it}{end}", "{open}{nothing} {within} {text} {says} {it}{end}", "{open}{it_is} {unknown}{end}", "{short}{end}", "{open}{I} {decline} {tell} {it}{end}", "{open}{I} {need} {info} {to} {tell} {it}{end}",
            "{open}{no_answer} {within} {text}{end}", "{open}{the_question} {passive}{end}", "{apology}, {I} {cannot} {tell} {it}{end}",
        ),
        "open": ["", "", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I'm afraid ", "I apologise, but ", "Honestly, ", "As an assistant, ", "From what I was given, ", "Having read the sources, "],
        "apology": ["Sorry", "My apologies", "Apologies", "Forgive me", "I regret", "Pardon"],
        "I": ["I", "I", "I", "we"], "to": ["to", "before I can"],
        "cannot": ["cannot", "can't", "am unable to", "am not able to", "could not", "couldn't", "can not", "am not in a position to", "will not", "won't"],
        "tell": ["answer", "tell", "say", "determine", "give", "state", "find", "provide", "confirm", "establish", "identify", "help with", "respond to", "speculate about", "comment on", "verify", "name", "work out"],
        "dont": ["do not", "don't", "did not", "really don't"], "know": ["know", "see", "recall", "recognise", "have any idea about", "have a clue about", "understand"], "have": ["have", "see", "find", "possess"],
        "enough": ["enough", "any", "sufficient", "the necessary", "adequate"],
        "info": ["information", "context", "evidence", "details", "data", "knowledge", "material", "further sources", "more documents", "facts"],
        "there": ["there is not", "there isn't", "I was not given", "I see no sign of", "we lack", "missing is", "there was not"],
        "within": ["in", "within", "from", "among", "across"], "text": ["the text", "the context", "the passages", "the documents", "the sources", "the given material", "these excerpts", "what was retrieved", "the chunks", "my notes", "the provided text", "the memory"],
        "silent": ["does not say", "do not mention", "doesn't state", "says nothing about", "gives no clue to", "never mentions", "is silent on", "does not contain", "do not provide", "fails to specify", "lacks", "leaves open"],
        "nothing": ["nothing", "no passage", "no statement", "no sentence", "not one line", "none of the entries"], "says": ["says", "supports", "indicates", "tells", "reveals", "refers to", "states", "points to"],
        "it": ["it", "that", "this", "the answer", "an answer", "a reply", "who that was", "what {n} did", "which one is meant", "where it is", "when that happened", "anything about {n}", "how {n} is involved", "the part of {n}", "your question", "", ""],
        "it_is": ["it is", "that is", "this remains", "the answer is", "this is", "it remains"], "unknown": ["unknown", "unclear", "not known", "not stated", "impossible to say", "not possible to determine", "uncertain", "not given", "not mentioned", "beyond my knowledge", "impossible to tell from the text", "undetermined", "not available to me"],
        "short": ["no idea", "can't say", "don't know", "not sure", "unknown", "unclear", "hard to say", "no clue", "not enough information", "insufficient information", "cannot be determined", "I pass", "I'd rather not say", "beats me", "no comment", "impossible to say", "I have no idea", "your guess is as good as mine", "I give up", "not answerable"],
        "decline": ["must decline to", "have to refuse to", "would rather not", "prefer not to", "must refrain from trying to", "am not allowed to", "am going to have to decline to"], "need": ["would need", "need", "require", "would have to see", "lack"],
        "no_answer": ["no answer can be given", "an answer could not be found", "the answer is not found", "no answer exists", "I found no answer", "there is no mention of {n}", "there is nothing about {n}", "I find no reference to {n}"],
        "the_question": ["the question", "this question", "that", "the query", "your request"], "passive": ["cannot be answered", "can't be answered from the text", "could not be resolved", "cannot be known", "is not something I can answer", "has no answer in the text", "cannot be determined"],
        "end": ["", "", "", "", ", honestly", ", I'm afraid", " from this", " with what I have", "; please provide more context", ". Could you share more", ", sorry", " based on these sources"],
    },
    "fr": {
        "rules": ("{open}{je} {dire} {cela}{end}", "{open}{texte} {muet} {cela}{end}", "{open}{rien} {dans}{end}", "{court}{end}", "{open}{il}{end}", "{open}{manque}{end}"),
        "open": ["", "", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "Je regrette, ", "Pardon, ", "Hélas, "],
        "je": ["je ne peux pas", "je ne suis pas en mesure de", "je ne saurais", "il ne m’est pas possible de", "je préfère ne pas", "je ne parviens pas à", "nous ne pouvons pas", "impossible pour moi de"], "dire": ["dire", "répondre à", "déterminer", "donner", "préciser", "trouver", "confirmer", "indiquer"],
        "cela": ["cela", "la réponse", "cette question", "de qui il s’agit", "ce que {n} a fait", "une réponse", "où cela se trouve"], "texte": ["le texte", "le contexte", "aucun passage", "les documents", "les sources", "les extraits fournis", "aucun document"],
        "muet": ["ne dit pas", "ne précise pas", "ne mentionne pas", "n’indique pas", "ne permet pas de connaître", "ne donnent pas", "ne contiennent pas", "ne révèle pas"], "rien": ["rien ne l’indique", "on ne trouve aucune mention de {n}", "il n’y a pas assez d’informations", "il n’y a aucun élément", "aucune réponse ne figure"], "dans": ["dans le texte", "dans les passages", "dans le contexte", "dans ces documents"],
        "court": ["je ne sais pas", "aucune idée", "inconnu", "impossible à dire", "je l’ignore", "sans réponse", "pas assez d’informations", "on ne sait pas", "je n’en sais rien"], "il": ["il est impossible de répondre", "il est impossible de le savoir", "ce n’est pas précisé", "cela reste inconnu", "la réponse n’est pas connue", "la question reste sans réponse"],
        "manque": ["je manque d’informations", "je ne dispose pas d’informations suffisantes", "il me faudrait plus de contexte", "les informations sont insuffisantes", "je n’ai pas assez d’éléments"], "end": ["", "", "", " pour répondre", " à partir de ces sources", ", désolé", " d’après ce que j’ai"],
    },
    "de": {
        "rules": ("{open}{ich} {das} {sagen}{end}", "{open}{text} {stumm} {das}{end}", "{open}{nichts}{end}", "{kurz}{end}", "{open}{es}{end}", "{open}{mangel}{end}"),
        "open": ["", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, ", "Bedaure, ", "Tut mir leid, ", "Verzeihung, "],
        "ich": ["ich kann nicht", "kann ich nicht", "ich vermag nicht", "ich bin nicht in der Lage,", "ich möchte nicht", "wir können nicht", "ich werde nicht", "mir ist es nicht möglich,"], "das": ["das", "diese Frage", "die Antwort", "wer gemeint ist", "was {n} tat", "eine Antwort", "wo das liegt"],
        "sagen": ["sagen", "beantworten", "bestimmen", "angeben", "ermitteln", "nennen", "herausfinden", "bestätigen"], "text": ["der Text", "der Kontext", "keine Passage", "kein Abschnitt", "die Quellen", "die Unterlagen", "kein Dokument", "die Abschnitte"],
        "stumm": ["sagt nichts über", "verrät nicht", "nennt nicht", "enthalten keine Angaben über", "gibt keine Auskunft über", "erwähnt nicht", "lassen offen", "liefert nicht"], "nichts": ["darüber steht nichts im Text", "dazu liegen keine Angaben vor", "aus den Quellen geht das nicht hervor", "im Kontext findet sich keine Antwort", "es gibt keine Hinweise darauf", "zu {n} findet sich nichts"],
        "kurz": ["keine Ahnung", "weiß ich nicht", "das weiß ich nicht", "unbekannt", "unklar", "nicht bekannt", "keine Angabe möglich", "schwer zu sagen", "ich weiß es nicht", "zu wenig Informationen"], "es": ["es ist nicht bekannt", "das lässt sich nicht sagen", "die Frage lässt sich nicht beantworten", "eine Antwort ist nicht möglich", "das bleibt unklar", "das kann man nicht wissen"],
        "mangel": ["mir fehlen die Informationen", "ich habe nicht genügend Informationen", "die Angaben reichen nicht aus", "ich brauche mehr Kontext", "dafür fehlen mir die Quellen"], "end": ["", "", "", " anhand dieser Quellen", ", leider", " nach dem, was vorliegt"],
    },
    "es": {
        "rules": ("{open}{yo} {decir} {eso}{end}", "{open}{texto} {mudo} {eso}{end}", "{open}{nada} {en}{end}", "{corto}{end}", "{open}{es}{end}", "{open}{falta}{end}"),
        "open": ["", "", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, ", "Perdón, ", "Por desgracia, ", "Disculpe, "],
        "yo": ["no puedo", "no soy capaz de", "no me es posible", "no sabría", "prefiero no", "no podemos", "no consigo", "me es imposible"], "decir": ["decir", "responder a", "determinar", "dar", "precisar", "encontrar", "confirmar", "contestar"], "eso": ["eso", "la respuesta", "esa pregunta", "de quién se trata", "qué hizo {n}", "una respuesta", "dónde está"],
        "texto": ["el texto", "el contexto", "ningún pasaje", "los documentos", "las fuentes", "los fragmentos dados", "ningún documento"], "mudo": ["no dice", "no aclara", "no menciona", "no indica", "no permite conocer", "no dan", "no contienen", "no revela"], "nada": ["nada lo indica", "no hay ninguna mención de {n}", "no hay información suficiente", "no aparece la respuesta", "no hay datos"], "en": ["en el texto", "en los pasajes", "en el contexto", "en estos documentos"],
        "corto": ["no lo sé", "ni idea", "desconocido", "imposible decirlo", "lo ignoro", "sin respuesta", "no se sabe", "falta información", "no tengo ni idea"], "es": ["es imposible responder", "no es posible saberlo", "no se especifica", "eso sigue siendo desconocido", "la respuesta no se conoce", "la pregunta no tiene respuesta"],
        "falta": ["no dispongo de información suficiente", "me falta información", "necesitaría más contexto", "los datos son insuficientes", "no tengo suficientes elementos"], "end": ["", "", "", " para responder", " según estas fuentes", ", lo siento", " con lo que tengo"],
    },
}
# Sentences of others' refusals, lacks and doubts, and titles: they only look like refusals.
NO_REFUSALS = {
    "rules": ("{who} {did_not} {do} {what}{why}.", "{who} {was} {state} {what}{why}.", "{title}", "It was {state} {do} {what} before 1900.", "{who} {said} that {they} {did_not} {do} {what}.", "{who} is {no_longer} known as {m}{but}."),
    "no_longer": ["no longer", "not", "never", "not any more", "hardly"], "but": ["", " but as {m}", ", only as {n}", " any more", " any more but as {m}", " today"],
    "who": ["{n}", "{n}", "It", "This", "The town", "He", "She", "They", "The mayor of {m}", "The council", "The author", "Nobody in {m}"], "they": ["he", "she", "they", "{n}"], "said": ["said", "wrote", "claimed", "told the court", "admitted"],
    "did_not": ["could not", "did not", "refused to", "was not able to", "never managed to", "declined to", "was unable to", "would not"], "do": ["attend", "answer", "cross", "reach", "find", "publish", "finish", "join", "say", "leave", "open", "explain", "to see", "know"],
    "what": ["{m}", "{n}", "the ceremony", "the court in {m}", "the river at {m}", "the hearing", "the manuscript", "the road to {m}", "the hall", "the letter of {n}", "the question of the judge", "the war", "the text of the treaty", "a word", "the source of the river"],
    "why": ["", "", " because of illness", " in 1801", " before 1850", " for lack of money", " until the end"], "was": ["was", "is", "was never", "is not"], "state": ["known as", "sorry to leave", "unknown in", "impossible to reach", "unable to see", "unclear about", "silent about", "possible to"],
    "title": ["Unknown Soldier of {m}", "The Unanswered Question", "Nobody Knows {m}", "No Answer from {m}", "I Cannot Stay", "The Silent Witness", "Sorry, Doctor", "I Do Not Sleep", "The Unknown Land", "No Information Desk", "A Question for {n}"],
}
# Names and titles in their own language, which are no answers in another language.
FOREIGN_TITLES = ["Musée de {m}", "Die Brücke von {m}", "El Jardín de {n}", "Le Pont de {m}", "Das Haus am See", "La Casa de {m}", "Der Garten von {n}", "Les Amis de {n}", "Los Amigos de {n}", "Théâtre de {m}", "Schloss {m}", "Palacio de {m}"]


#: Words of denial, of the one who answers and of what an answer rests on (fixed values), told apart from names by their small letters.
DENIALS = frozenset("not no silent fails cannot can't couldn't don't didn't doesn't isn't won't unable nothing none never neither without unknown unclear impossible insufficient lacks lack ne pas aucun aucune rien impossible inconnu sans n’est n’y nicht kein keine keinen nichts unbekannt unklar ohne no ni ningún ninguna nada imposible desconocido sin".split())
SPEAKERS = frozenset("i i'm i'd i’m we my me je j’ai me m’est nous mon ich mir wir mich mein yo me nos mi puedo sé tengo dispongo".split())
GROUNDS = frozenset("text context passage passages document documents source sources information evidence answer question answered data material excerpts chunks memory reply texte contexte passages informations réponse question sources documents extraits text kontext passage quellen angaben informationen antwort frage abschnitt texto contexto pasaje pasajes información respuesta pregunta fuentes documentos datos".split())


def composed(rng: np.random.Generator, grammar: dict[str, list[str] | tuple[str, ...]], rule: str | None = None, **names: str) -> str:
    """A text by one rule of a grammar."""
    text = rule or grammar["rules"][int(rng.integers(len(grammar["rules"])))]
    while (m := re.search(r"\{(\w+)\}", text)) is not None:
        slot = m.group(1)
        text = text[: m.start()] + (names[slot] if slot in names else grammar[slot][int(rng.integers(len(grammar[slot])))]) + text[m.end() :]
    return re.sub(r" +([.,;]|$)", r"\1", re.sub(r"  +", " ", text)).strip()


def plain(answer: str) -> str:
    """An answer without a marker in front."""
    before = None
    while before != answer:
        before, answer = answer, MARKER.sub("", answer, count=1)
    return answer


def tokens(text: str) -> list[str]:
    return _WORD.findall(text)


@lru_cache(maxsize=1 << 16)
def language(text: str) -> str:
    """The language of a question, by its function words; English where there are none."""
    score = _language_scores(text)
    best = max(score, key=lambda k: score[k])
    return best if score[best] > 0 else "en"


def _language_scores(text: str) -> dict[str, float]:
    # Names, and the short words within them, say nothing of the language.
    low = [w.lower() for w in tokens(text)]
    score = {}
    for lang, known in _ONLY.items():
        score[lang] = sum(1.0 / sum(w in other for other in _ONLY.values()) for w in low if w in known)
    score["de"] += 0.5 * sum("ß" in w for w in low)
    score["es"] += 1.0 * ("¿" in text or "¡" in text)
    return score


def _sequence_overlap(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence of two word lists."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        kept = row & masks.get(w, 0)
        row = (row + kept) | (row - kept)
    return len(a) - (row & full).bit_count()


def _title(words: list[str], text: str) -> bool:
    """Whether a short text is built as a name or title: capitals but for particles, no sentence mark at its end."""
    if not words or len(words) > 7 or text.rstrip()[-1:] in ".!?…":
        return False
    small = [w for w in words if not (w[:1].isupper() or w[:1].isdigit())]
    return len(small) < len(words) / 2 + 0.5 and all(len(w) <= 3 for w in small)


def _mask(word: str, asked: frozenset[str], first: bool) -> str:
    low = word.lower()
    if word[0].isdigit():
        return "9"
    if word[0].isupper() and not (first and any(low in known for known in _ONLY.values())):
        return "Q" if low in asked else "X"
    return low


DENSE = 48


@dataclass
class Features:
    """Hashed n-grams (indices) and dense pair features of one answer."""

    hashed: list[int] = field(default_factory=list)
    dense: np.ndarray = field(default_factory=lambda: np.zeros(DENSE, dtype=np.float32))


def _gram(kind: str, *parts: str) -> int:
    return xxhash.xxh32_intdigest(" ".join((kind, *parts))) % HASHED


#: Word to the logarithm of its share in each language, as counted in the answers for training.
Lexicon = dict[str, tuple[float, ...]]


def _word_counts(whole: list[tuple[str, str, str]]) -> dict[str, np.ndarray]:
    counts: dict[str, np.ndarray] = {}
    for q, a, _ in whole:
        at = list(FUNCTION_WORDS).index(language(q))
        for text in (q, a):
            for i, w in enumerate(tokens(text)):
                if w[0].islower() or i == 0:
                    counts.setdefault(w.lower(), np.zeros(len(FUNCTION_WORDS)))[at] += 1
    return counts


def _lexicon_of(counts: dict[str, np.ndarray], totals: np.ndarray) -> Lexicon:
    out = {}
    for w, n in sorted(counts.items()):
        share = n / (totals + 1.0) + 1e-5
        out[w] = tuple(np.log(share / share.sum()).tolist())
    return out


def _lexicon(whole: list[tuple[str, str, str]]) -> Lexicon:
    counts = _word_counts(whole)
    return _lexicon_of({w: n for w, n in counts.items() if n.sum() >= 3}, sum(counts.values()) if counts else np.zeros(len(FUNCTION_WORDS)))


def count_words(rows: DataFrame, question: str, answer: str, reference: str) -> Lexicon:
    """The lexicon of all rows whose answer looks whole, of words that make up at least one in ``LEXICON_WORDS`` words."""
    langs = list(FUNCTION_WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _word_counts(_whole(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))))
            sums = np.array(list(counts.values())).reshape(-1, len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(sums[:, i].astype(np.int64)) for i in range(len(langs)))], ["word", *langs])

    shape = "word string, " + ", ".join(f"{lang} bigint" for lang in langs)
    counted = cut(rows.select(question, answer, reference).mapInArrow(count, shape).groupBy("word").agg(*[F.sum(lang).alias(lang) for lang in langs]))
    totals = np.array([x or 0 for x in counted.agg(*[F.sum(lang) for lang in langs]).first()], dtype=float)
    least = max(3, -(-int(totals.sum()) // LEXICON_WORDS))
    held = counted.where(sum((F.col(lang) for lang in langs), F.lit(0)) >= least).collect()
    return _lexicon_of({r["word"]: np.array(r[1:], dtype=float) for r in held}, totals)


def _spoken(words: list[str], lexicon: Lexicon) -> dict[str, float]:
    """The log-likelihood of each language by the words that are no names."""
    total = np.zeros(len(FUNCTION_WORDS))
    for i, w in enumerate(words):
        if (w[0].islower() or i == 0) and (known := lexicon.get(w.lower())):
            total += known
    return dict(zip(FUNCTION_WORDS, total.tolist(), strict=True))


def describe(question: str | None, answer: str | None, reference: str | None, lexicon: Lexicon) -> Features:
    """Features of an answer to a question; the reference answer, where there is one, tells what a whole answer holds."""
    out = Features()
    d = out.dense
    question, answer = question or "", plain(answer or "")
    words, q_words = tokens(answer), tokens(question)
    low, q_low = [w.lower() for w in words], [w.lower() for w in q_words]
    bare = answer.strip(" \t\r\n\"'“”«»()[]{}.,;:!?-–—").lower()
    stripped = answer.rstrip()
    d[0] = not any(c.isalnum() for c in answer)
    d[1] = bare in FILLERS
    n = len(low)
    d[2:7] = n <= 1, n <= 3, n <= 6, n <= 12, n > 12
    if n:
        # Giving back the question.
        if q_low:
            common = _sequence_overlap(low, q_low)
            d[7], d[8] = common / n, common / len(q_low)
            d[9] = d[7] * d[8]
            d[10] = d[9] > 0.7
            d[11] = d[7] > 0.9 and len(q_low) > 3 and d[8] > 0.8
            d[12] = low[:2] == q_low[:2] and n > 1
            twice = len(q_low) and n >= 1.7 * len(q_low) and _sequence_overlap(low[: len(q_low)], q_low) > 0.8 * len(q_low) and _sequence_overlap(low[-len(q_low) :], q_low) > 0.8 * len(q_low)
            d[13] = bool(twice)
        d[14] = stripped[-1:] == "?" or "?" in stripped[-3:]
        # Language of the answer against that of the question.
        asked = language(question)
        title = _title(words, stripped) and not d[1]
        score = _spoken(words, lexicon)
        own = score.pop(asked)
        other = max(score.values())
        apart = other - own
        spoken = {lang for lang, said in YES_NO.items() if low[0] in said}
        if title and not spoken:
            apart = -1.0
        d[15], d[16] = np.clip(apart / 10, -1, 1), np.clip(apart / max(n, 1), -2, 2)
        d[17] = apart > 1
        d[18] = apart > 4
        d[19] = bool(spoken) and asked not in spoken
        d[20] = bool(spoken) and asked in spoken
        d[21] = title
        d[37] = n == 1 and bool(spoken) and asked not in spoken
        d[38] = apart > 8
        # The end.
        stops = ".!?…。\"”»)"
        d[22] = stripped[-1:] in stops and not stripped.endswith("...")
        d[23] = stripped[-1:] in ",;:-–—(" or stripped.endswith("...")
        d[24] = low[-1] in _ONLY[asked]
        if reference is not None:
            ref = [w.lower() for w in tokens(reference)]
            holds = bool(ref) and len(ref) <= n and any(low[i : i + len(ref)] == ref for i in range(n - len(ref) + 1))
            d[25] = holds
            d[26] = bool(ref) and low[-len(ref) :] == ref
            d[27] = holds and not d[22]
            known = set(ref) | set(q_low)
            part = any(w.startswith(low[-1]) and w != low[-1] for w in known) and low[-1] not in known
            d[28] = part and words[-1][-1] not in "’'"
            d[29] = bool(ref) and n < len(ref) and ref[:n] == low
            d[30] = bool(ref) and n <= len(ref) and ref[: n - 1] == low[:-1] and ref[n - 1] != low[-1] and ref[n - 1].startswith(low[-1])
            # Names of the question that the answer begins but does not end.
            tail = words[-1].lower()
            d[31] = any(a == tail and i + 1 < len(q_words) and q_words[i + 1][:1].isupper() and q_words[i][:1].isupper() for i, a in enumerate(q_low[:-1])) and not any(a == tail and (i + 1 == len(q_words) or not q_words[i + 1][:1].isupper()) for i, a in enumerate(q_low))
            d[32] = not holds and not title and not d[22]
            d[33] = d[28] and not d[22]
            d[34] = title and not d[29] and not d[30]
            d[39] = not d[22] and bool(re.search(r"\w[.!?] +\w", stripped))
        # Denying, speaking for oneself, and speaking of what an answer rests on.
        known_q = frozenset(q_low)
        small = [w for i, w in enumerate(low) if i == 0 or not words[i][0].isupper() or w.startswith("i")]
        denies, speaks, rests = (any(w in held and w not in known_q for w in small) for held in (DENIALS, SPEAKERS, GROUNDS))
        named = any(w[0].isupper() and w.lower() not in known_q for w in words[1:])
        d[40:47] = denies, denies and speaks, denies and rests, speaks, denies and speaks and not named, denies and not named and n <= 6, denies and rests and not named
        d[47] = denies and not speaks and not rests
        seq = [_mask(w, known_q, i == 0) for i, w in enumerate(words)]
        # Names of several words count as one.
        seq = [w for i, w in enumerate(seq) if i == 0 or w not in ("X", "Q") or seq[i - 1] != w]
        grams = set()
        for k in (1, 2, 3):
            for i in range(len(seq) - k + 1):
                grams.add(_gram("w", *seq[i : i + k]))
        for k in (1, 2, 3, 4):
            grams.add(_gram("end", stripped[-1] if not stripped[-1].isalnum() else "", *seq[-k:]))
        grams.add(_gram("start", *seq[:2]))
        # First-person and second-person forms and verbs, whether or not the case was changed.
        for k in (1, 2):
            for i in range(n - k + 1):
                if not any(c.isdigit() for c in low[i]) and low[i] not in known_q:
                    grams.add(_gram("l", *low[i : i + k]))
        for w in low:
            if not title and w not in known_q:
                grams.add(_gram("t", asked, w))
        for said in spoken:
            grams.add(_gram("yn", asked, said, low[0]))
        # The words of a filler say nothing.
        out.hashed = [_gram("filler")] if d[1] else sorted(grams)
    d[35] = 1.0
    d[36] = not n
    return out


@dataclass
class Model:
    """Weights and thresholds by label."""

    weights: dict[str, np.ndarray]
    thresholds: dict[str, float]
    lexicon: Lexicon

    def scores(self, features: Features) -> dict[str, float]:
        """Score minus threshold by label."""
        out = {}
        for label, w in self.weights.items():
            out[label] = float(w[features.hashed].sum() + features.dense @ w[HASHED:]) - self.thresholds[label]
        return out

    def labels(self, question: str | None, answer: str | None, reference: str | None, labels: tuple[str, ...] = LABELS) -> list[str]:
        """The labels that reach their threshold, the one that does so by most first."""
        scores = self.scores(describe(question, answer, reference, self.lexicon))
        return sorted((k for k in labels if scores[k] > 0), key=lambda k: -scores[k])

    def defect(self, question: str | None, answer: str | None, reference: str | None, labels: tuple[str, ...] = LABELS) -> str | None:
        """The defect of an answer, if any: of its labels the one that reaches its threshold by most."""
        return next(iter(self.labels(question, answer, reference, labels)), None)


def _train_label(rows: list[Features], y: np.ndarray, weight: np.ndarray, use: np.ndarray, epochs: int = 12, rate: float = 0.25, decay: float = 2e-6, keep: float = 1.0) -> np.ndarray:
    """Logistic regression by mini-batches with adaptive steps; ``use`` masks dense features that the label may not see.

    ``keep`` leaves out n-grams at random, so that what holds for any wording gets its weight too.
    """
    w = np.zeros(HASHED + DENSE)
    speed = np.full(HASHED + DENSE, 1e-2)
    dense = np.stack([r.dense for r in rows]) * use
    sizes = np.array([len(r.hashed) for r in rows])
    flat = np.concatenate([np.array(r.hashed, dtype=np.int64) for r in rows])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            at = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes[batch])
            if keep < 1:
                stays = rng.random(len(at)) < keep
                at, owner = at[stays], owner[stays]
            z = np.bincount(owner, w[at], len(batch)) / keep + dense[batch] @ w[HASHED:]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch]
            grad = np.bincount(at, error[owner], HASHED)
            full = np.concatenate([grad, error @ dense[batch]]) / len(batch) + decay * w
            speed += full**2
            w -= rate * full / np.sqrt(speed)
    return w


def _whole(rows: list[tuple[str, str | None, str | None]]) -> list[tuple[str, str, str]]:
    """The rows whose answer looks whole: the reference itself or a text in the question's language that holds it."""
    whole = []
    for q, a, r in rows:
        if not q or not a or not r:
            continue
        bare = plain(a).strip()
        held = r.strip() and r.lower() in bare.lower() and language(q) in (language(bare), language(q) if len(tokens(bare)) < 6 else "")
        if any(c.isalnum() for c in bare) and (bare == r or held) and _sequence_overlap([w.lower() for w in tokens(bare)], [w.lower() for w in tokens(q)]) < 0.9 * len(tokens(q)) and bare.lower() not in FILLERS:
            whole.append((q, bare, r))
    return whole


def _spans(question: str) -> list[str]:
    """The names in a question: runs of capitalised words, the first word of the question left out."""
    return [m.group() for m in re.finditer(r"[A-ZÀ-Þ]\w+(?: (?:of|and|for) [A-ZÀ-Þ]\w+| [A-ZÀ-Þ]\w+)*", question) if m.start() > 1]


def _make(rows: list[tuple[str, str | None, str | None]], seed: int = 5, held_out: frozenset[int] = frozenset()) -> list[tuple[str, str | None, str | None, str | None]]:
    """(question, answer, reference, label or None): whole answers and defects made from them.

    ``held_out`` leaves rules of the grammars of refusals out, by their places, to measure what wordings never seen give.
    """
    rules = {lang: [rule for i, rule in enumerate(g["rules"]) if i not in held_out] for lang, g in REFUSALS.items()}
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    whole = _whole(rows)
    by_language: dict[str, list[tuple[str, str, str]]] = {lang: [] for lang in FUNCTION_WORDS}
    for q, a, r in whole:
        by_language[language(q)].append((q, a, r))
    said = {lang: {a.rstrip(".").lower() for _, a, _ in held} for lang, held in by_language.items()}
    names = [n for q, _, _ in whole for n in re.findall(r"[A-Z]\w+ [A-Z]\w+", q)][:5000] or ["Anna Bell"]
    places = [n for _, _, r in whole for n in [r] if len(tokens(r)) == 1 and r[:1].isupper()][:5000] or ["Ashford"]

    def styled(text: str) -> str:
        turn = rng.random()
        text = text[:1].upper() + text[1:] if turn < 0.75 else text.lower() if turn < 0.9 else text
        if rng.random() < 0.2:
            text = text.rstrip(".")
        return f"FINAL_ANSWER_TEXT: {text}" if rng.random() < 0.05 else text

    made: list[tuple[str, str | None, str | None, str | None]] = []
    for q, a, r in whole:
        made.append((q, a, r, None))
        sentence = len(tokens(a)) > 5
        if sentence:
            made.append((q, a.rstrip("."), r, None))
        elif rng.random() < 0.3:
            made.append((q, a + ".", r, None))
        if rng.random() < 0.5:
            # A wrong answer is none of the defects.
            made.append((q, pick(whole)[2], r, None))
        if rng.random() < 0.3 and (spans := _spans(q)):
            made.append((q, pick(spans), r, None))
        if rng.random() < 0.3:
            made.append((q, styled(composed(rng, NO_REFUSALS, n=pick(names), m=pick(places))), r, None))
        if rng.random() < 0.1:
            made.append((q, pick(FOREIGN_TITLES).format(n=pick(names), m=pick(places)), r, None))
        # Cut off.
        for _ in range(2 if sentence else 1):
            if sentence or len(a) > 12:
                low = int(len(a) * (0.25 if sentence else 0.5))
                at = int(rng.integers(low, max(low + 1, len(a) - 3)))
                piece = a[:at].rstrip() if rng.random() < 0.8 else a[: max(a.rfind(" ", 0, at), low)].rstrip() + pick(["", ",", "-", "..."])
                if sentence or (len(piece) > 3 and " " in a and piece.lower() != r.lower()):
                    made.append((q, piece, r, "truncated"))
        # The question given back.
        if rng.random() < 0.4:
            copy, turn = q, rng.random()
            words = q.split(" ")
            if turn < 0.2:
                copy = q.rstrip(" ?.")
            elif turn < 0.4:
                copy = q.lower()
            elif turn < 0.55 and len(words) > 5:
                del words[int(rng.integers(len(words)))]
                copy = " ".join(words)
            elif turn < 0.65:
                copy = f"{q} {q}"
            elif turn < 0.75:
                copy = pick(["“", "- ", "Question: ", '"', "Q: "]) + q
            elif turn < 0.85:
                copy = "  ".join(words) + "\n"
            made.append((q, copy, r, "copied_question"))
        if rng.random() < 0.1:
            lang = pick(sorted(YES_NO))
            said_so = pick(YES_NO[lang]).capitalize() + pick(["", "."])
            made.append((q, said_so, r, None if said_so.rstrip(".").lower() in YES_NO[language(q)] else "other_language"))
        # Swapped: the answer to a question in another language.
        if rng.random() < 0.6:
            other = pick([lang for lang in by_language if lang != language(q)])
            if by_language[other]:
                q2, a2, r2 = pick(by_language[other])
                if len(tokens(a2)) > 5 or a2.rstrip(".").lower() in YES_NO[other]:
                    if a2.rstrip(".").lower() not in said[language(q)] and a2.rstrip(".").lower() not in YES_NO[language(q)]:
                        # A real answer speaks of what its question names.
                        for mine, theirs in zip(_spans(q), _spans(q2), strict=False):
                            a2 = a2.replace(theirs, mine)
                        made.append((q, a2, r2, "other_language"))
        if rng.random() < 0.5:
            grammar = {k: v for k, v in REFUSALS[language(q)].items() if k != "rules"} | {"rules": rules[language(q)]}
            n = pick(names if rng.random() < 0.5 else re.findall(r"[A-Z]\w+(?: [A-Z]\w+)*", q) or names)
            text = composed(rng, grammar, n=n)
            text += "" if text[-1] in ".?" else "."
            made.append((q, styled(text), r, "refusal"))
        if rng.random() < 0.2:
            nothing = rng.random() < 0.4
            empty = pick([None, "", " ", "\n", "-", "—", "[]", "{}", '""', "?", "...", "FINAL_ANSWER_TEXT:", "Answer:"]) if nothing else pick(sorted(FILLERS))
            if not nothing:
                empty = pick([empty, empty.upper(), empty.capitalize(), f"[{empty}]", f"({empty})", f"{empty}.", f"FINAL_ANSWER_TEXT: {empty}"])
            made.append((q, empty, r, "empty"))
    # The reference answer may be missing or broken; a cut-off short name then shows no more than itself.
    lost = rng.random(len(made)) < 0.2
    return [(q, a, None if gone and not (label == "truncated" and len(tokens(a or "")) < 4) else r, label) for (q, a, r, label), gone in zip(made, lost, strict=True)]


#: Share of the n-grams of an example that training sees: these must be known by more than their wording.
KEEP = {"refusal": 0.4, "empty": 0.4}
#: Dense features that rest on the reference answer; only the label of cut-off answers may use them.
WITH_REFERENCE = (*range(25, 35), 39)


#: Describes (question, answer, reference, label) examples with a lexicon.
Describer = Callable[[list[tuple[str, str | None, str | None, str | None]], Lexicon], list[Features]]


def _described(made: list[tuple[str, str | None, str | None, str | None]], lexicon: Lexicon) -> list[Features]:
    return [describe(q, a, r, lexicon) for q, a, r, _ in made]


def described_in_tasks(spark: SparkSession) -> Describer:
    """A describer that shares the work out to the executors; the examples are as bounded as the sample."""

    def run(made: list[tuple[str, str | None, str | None, str | None]], lexicon: Lexicon) -> list[Features]:
        shared = spark.sparkContext.broadcast(lexicon)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [describe(q, a, r, shared.value) for q, a, r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.hashed for f in found], pa.list_(pa.int32())), pa.array([f.dense.tobytes() for f in found], pa.binary())], ["i", "hashed", "dense"])

        given = pd.DataFrame([(i, q, a, r) for i, (q, a, r, _) in enumerate(made)], columns=["i", "q", "a", "r"])
        table = spark.createDataFrame(given, "i long, q string, a string, r string").repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(rows, "i long, hashed array<int>, dense binary").toArrow()
        out = [Features() for _ in made]
        for i, hashed, dense in zip(*(table[c].to_pylist() for c in ("i", "hashed", "dense")), strict=True):
            out[i] = Features(hashed, np.frombuffer(dense, dtype=np.float32))
        return out

    return run


def train(rows: list[tuple[str, str | None, str | None]], lexicon: Lexicon | None = None, described: Describer = _described, held_out: frozenset[int] = frozenset()) -> Model:
    """A model from (question, answer, reference) rows; thresholds from the fifth of the questions kept out."""
    made = _make(rows, held_out=held_out)
    kept_out = np.array([xxhash.xxh32_intdigest(q, seed=3) % 5 == 0 for q, *_ in made], dtype=bool)
    lexicon = _lexicon(_whole(rows)) if lexicon is None else lexicon
    features = described(made, lexicon)
    labels = np.array([label or "" for *_, label in made])
    weights, thresholds = {}, {}
    for label in LABELS:
        y = (labels == label).astype(float)
        use = np.ones(DENSE)
        if label != "truncated":
            use[list(WITH_REFERENCE)] = 0
        fit = np.flatnonzero(~kept_out)
        w = _train_label([features[i] for i in fit], y[fit], np.ones(len(fit)), use, keep=KEEP.get(label, 1.0)) if len(fit) else np.zeros(HASHED + DENSE)
        if label != "truncated":
            w[[HASHED + i for i in WITH_REFERENCE]] = 0
        weights[label] = w
        held = np.flatnonzero(kept_out)
        z = np.array([w[features[i].hashed].sum() + features[i].dense @ w[HASHED:] for i in held])
        thresholds[label] = _threshold(z, y[held]) if len(held) else 0.0
    return Model(weights, thresholds, lexicon)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the scores that give the best F1 on held-out answers, or less by no more than 0.004."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1.0, y.sum()))
    good = np.flatnonzero(f1 >= f1.max() - 0.004)
    after = z[order[good[-1] + 1]] if good[-1] + 1 < len(z) else z[order[good[-1]]] - 2
    return float((z[order[good[0]]] + after) / 2)


def sample(rows: DataFrame, key: str, question: str, answer: str, reference: str) -> list[tuple[str, str | None, str | None]]:
    """At most ``TRAIN_ROWS`` rows for training: those of the smallest hashes, whatever the order of the table."""
    picked = rows.select(question, answer, reference, F.xxhash64(F.col(key), F.col(question), F.col(answer)).alias("__h")).dropDuplicates(["__h"]).orderBy("__h").limit(TRAIN_ROWS)
    return [(r[0], r[1], r[2]) for r in picked.collect()]


def fitted(rows: DataFrame, key: str, question: str, answer: str, reference: str) -> Model:
    """A model for ``rows``: words counted over all of them, weights fitted to the sample."""
    return train(sample(rows, key, question, answer, reference), count_words(rows, question, answer, reference), described_in_tasks(rows.sparkSession))


def labelled(rows: DataFrame, key: str, question: str, answer: str, reference: str, model: Model) -> DataFrame:
    """(key, field, labels): the answers with a label, and all labels that reach their threshold, the surest first.

    ``field`` names the answer or the reference column. Null questions count as empty, null answers have no content. A
    row delivered again gives the same rows again; an empty table gives none.
    """
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = lru_cache(maxsize=1 << 16)(shared.value.labels)
        for batch in batches:
            out = []
            for k, q, a, r in zip(batch["k"], batch["q"], batch["a"], batch["r"], strict=True):
                usable = r is not None and any(c.isalnum() for c in r) and r.strip().lower() not in FILLERS
                if found := judged(q, a, r if usable else None):
                    out.append((k, answer, found))
                if found := judged(q, r, None, GOLD_LABELS):
                    out.append((k, reference, found))
            yield pd.DataFrame(out, columns=["k", "field", "labels"])

    given = rows.select(F.col(key).cast("string").alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(reference).alias("r"))
    return given.mapInPandas(judge, "k string, field string, labels array<string>").select(F.col("k").cast(kind).alias(key), "field", "labels")


def defects(rows: DataFrame, key: str, question: str, answer: str, reference: str, model: Model) -> DataFrame:
    """(key, field, defect): every defective answer with its surest label; ``field`` names the answer or the reference column."""
    return labelled(rows, key, question, answer, reference, model).select(key, "field", F.get("labels", F.lit(0)).alias("defect"))
