"""Defective question-answer pairs and the kind of their defect.

One pass over the answers, each kind by its own means: a suffix automaton of the prompt's
words measures how much of an answer is copied; an automaton finds the parts of refusals,
which must stand in one clause; stacks of delimiters, known labels and sentence ends show
what breaks off; votes of stopwords and scripts tell languages apart.

Cases: a null answer is ``empty``; with a null or blank question only the copy and the
language cannot be judged. An unknown or null TaskType gets the rules for free text. Each
pair has at most one defect, the first found in the order empty, refusal, copied_question,
other_language, truncated. Answers of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrid.functions.fields import category

#: Most labels that may be read to the driver and sent to every task.
MAX_TERMS = 1_000_000
#: A run of copied words counts from this length.
COPIED_RUN = 3

# Texts that stand for no answer.
PLACEHOLDERS = {
    "n a", "na", "null", "none", "nan", "nil", "empty", "undefined", "missing", "tbd", "todo", "blank",
    "no answer", "no response", "no reply", "not available", "not applicable", "not provided", "unanswered",
    "keine antwort", "keine angabe", "entfällt", "sans réponse", "pas de réponse", "aucune réponse",
    "sin respuesta", "no aplica", "placeholder", "answer here", "insert answer here",
}

# What refuses by itself, without accents and apostrophes.
REFUSALS = [
    "unable to comply", "cannot comply", "cant comply", "not able to comply", "as an ai", "as a language model", "not allow me to", "does not allow me",
    "no answer can be given", "no answer can be provided", "outside what i may do", "beyond what i can do", "not be appropriate for me", "against my guidelines",
    "i must decline", "i have to decline", "i decline to", "i refuse to", "i am not permitted", "im not permitted", "i am not allowed", "im not allowed",
    "je ne suis pas autorise", "il mest impossible", "il ne mest pas possible", "en tant que modele", "en tant quia", "en tant quassistant", "je refuse de", "je dois refuser", "ne me permettent pas",
    "als ki", "als sprachmodell", "als modell", "erlauben mir nicht", "erlauben es mir nicht", "ich lehne ab", "muss ich ablehnen", "darf ich nicht", "ist mir nicht moglich",
    "no me es posible", "me es imposible", "no estoy autorizado", "no me permiten", "como modelo", "como ia", "me niego a", "debo rechazar", "no debo",
    "non mi e possibile", "non sono autorizzato", "come modello", "nao me e possivel", "nao estou autorizado", "como um modelo",
]
# What declines together with an act of answering in the same clause.
DECLINING = [
    "i cannot", "i cant", "i can not", "i could not", "i wont", "i will not", "i may not", "i am unable to", "im unable to", "i am not able to", "im not able to",
    "i do not", "i dont", "we cannot", "we cant", "we do not", "we are unable to", "we are not able to",
    "je ne peux", "je ne puis", "je ne saurais", "je ne suis pas en mesure", "je ne", "nous ne pouvons", "nous ne",
    "ich kann", "kann ich", "konnen wir", "wir konnen", "ich darf", "bin ich nicht", "ich bin nicht", "ich", "gebe ich",
    "no puedo", "no podemos", "no estoy en condiciones", "no soy capaz", "no doy", "no ofrezco", "no emito", "no proporciono", "no interpreto", "non posso", "non sono in grado", "nao posso", "nao consigo",
]
# Acts of answering, by the beginning of their words.
ACTS = (
    "answer help assist provid giv interpret diagnos comply fulfil assess comment offer evaluat analy read discuss "
    "repond aid fourni donn interpret diagnosti evalu analys comment "
    "beantwort helf geb gib stell interpretier diagnos beurteil befund auswert bewert bereitstell abgeb "
    "respond ayud proporcion dar doy ofrec emit interpret diagnostic evalu analiz coment "
    "rispond aiut fornir dare ajud fornec"
).split()
#: After phrases that end with one of the first words, one of the second must follow.
NEEDS_DENIAL = {"kann", "ich", "konnen", "wir", "darf", "ne", "peux", "pouvons", "saurais", "puis"}
DENIALS = {"nicht", "kein", "keine", "keinen", "keinerlei", "pas", "aucun", "aucune"}
# Words of sentences that explain a refusal, without accents.
EXPLAINING = set(
    "sorry apologize apologies unfortunately professional physician doctor specialist radiologist clinician expert consult policy "
    "policies guidelines advice safety ai model assistant instead qualified trained training diagnosis request help understand "
    "desole malheureusement specialiste medecin radiologue conseil consultez regles consignes modele "
    "leider arzt arztin facharzt radiologe radiologin fachperson richtlinien modell sprachmodell beratung "
    "lamentablemente medico especialista radiologo profesional consulte normas modelo ayuda".split()
)

# Function words of the languages, and the words for answer, probably and about.
STOPWORDS = {
    "en": "probably approximately about answer a an the and or but nor if than then as at by for from in into of off on onto out over to under up with without about after again against between "
    "before below both during through until while because so such only own same too very not no yes i me my we us our you your he him his she her it its they "
    "them their this that these those which who whom whose what when where why how all any each few more most other some is am are was were be been being have "
    "has had do does did will would shall should can could may might must there here",
    "fr": "probablement environ réponse le la les l un une des du de d et ou mais ni car donc or si que qui quoi dont où à au aux en dans par pour sur sous sans avec chez vers entre contre "
    "depuis pendant avant après selon je j tu il elle on nous vous ils elles me m te se s lui leur ce c cet cette ces mon ma mes ton sa son ses notre nos votre "
    "vos ne n pas plus moins très aussi bien comme est sont était ont a avait être avoir fait peut y quel quelle quels quelles près plusieurs aucun aucune",
    "de": "wahrscheinlich ungefähr antwort der die das den dem des ein eine einen einem einer eines und oder aber denn sondern wenn als wie ob dass weil da in im an am auf aus bei beim mit nach "
    "seit von vom zu zum zur für durch gegen ohne um über unter vor hinter neben zwischen bis ich du er sie es wir ihr mich mir dich sich uns ihn ihm ihnen mein "
    "sein seine ihre unser dieser diese dieses diesem diesen welcher welche welches was wer wo nicht kein keine keinen auch nur noch schon sehr so hier ist sind "
    "war waren bin wird werden wurde wurden hat haben hatte kann können soll muss sowie",
    "es": "probablemente aproximadamente respuesta el la los las un una unos unas lo y e o u pero sino ni si que quien cual cuál cuáles cuyo donde cuando como cómo qué a al ante bajo con contra de del "
    "desde en entre hacia hasta para por según sin sobre tras yo tú él ella ello nosotros ellos ellas me te se nos le les su sus mi mis tu este esta esto estos "
    "estas ese esa esos esas aquel no ni muy más menos también ya es son era fue está están ser estar hay ha han había puede pueden unos algún ningún cuántos cuántas pues",
    "it": "probabilmente circa risposta il lo la i gli le un uno una e ed o ma né se che chi cui quale quali dove quando come perché a ad al allo alla ai agli alle da dal dallo dalla dai di d "
    "del dello della dei degli delle in nel nello nella nei nelle con su sul sulla sui per tra fra io tu lui lei noi voi loro mi ti si ci vi ne questo questa "
    "questi queste quello quella non più meno molto anche è sono era ha hanno essere avere può c l",
    "pt": "provavelmente aproximadamente resposta o a os as um uma uns umas e ou mas nem se que quem qual quais cujo onde quando como ao à aos às de do da dos das em no na nos nas por pelo pela pelos "
    "para com contra desde entre até sem sob sobre após eu tu ele ela nós vós eles elas me te lhe lhes seu sua seus suas meu minha este esta estes estas esse essa "
    "isto isso aquele não mais menos muito também já é são era foi está estão ser estar há tem têm pode podem",
    "nl": "waarschijnlijk ongeveer antwoord de het een en of maar want dat die dit deze wie wat waar wanneer hoe in op aan bij met van voor door over onder tussen naar uit om tot zonder tegen na "
    "te ik jij hij zij ze we wij jullie mij hem haar ons hun zijn is was waren ben wordt worden werd heeft hebben had kan kunnen moet zal niet geen ook nog er "
    "zich als dan",
}

# Function words after which no answer ends.
HANGING = set(
    "the a an of and or in on at to by with from for is are was were be about between near that which this than as into "
    "over under its there der die das des dem den ein eine einer einem einen und oder "
    "ist sind im am auf mit von zu bei für le la les de du et ou un une est sont dans sur avec pour par au aux "
    "el los las del y es son en con para que se al il lo gli di os um uma do da em com".split()
)
LEADS = {"question", "frage", "pregunta", "q", "prompt", "answer", "antwort", "réponse", "respuesta"}

BEYOND_LATIN = re.compile(r"[^\x00-\u036f]")
APOSTROPHES = re.compile(r"['’`]")
WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
OPTION = re.compile(r"(?:(?<=^)|(?<=[\s,;:(]))\(?([A-Za-z])\s?[).:]\s+(?=\S)")
REPLY_LETTER = re.compile(r"(?:->|=>|→|:|\n)\s*\(?([A-Z])\)?[.)]?\s*$")
GOES_ON = re.compile(r"\s+(?=[^\W\d_a-zà-öø-ÿ])|[^\w\s'’-]")
ANY_WORD = re.compile(r"\s+(?=\w)|[^\w\s'’-]")
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
CLAUSE = re.compile(r"[.,;:!?…。！？\n]+")
#: A letter that ends a sentence: the option it states.
LETTER = re.compile(r"\b([A-Z])\)?[.!]?$")
STATED = re.compile(r"(?:^|\b(?:is|est|ist|es|answer|réponse|antwort|respuesta)\s*:?\s*)\(?([A-Z])\)?\s*[.:)]\s*(.*)$", re.S)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _bare(text: str) -> str:
    """Lower-case words without accents and apostrophes, single blanks."""
    text = APOSTROPHES.sub("", text.lower())
    if text.isascii():
        return " ".join(WORD.findall(text))
    text = unicodedata.normalize("NFKD", text)
    return " ".join(WORD.findall("".join(c for c in text if not unicodedata.combining(c))))


def _script(sequence: list[str]) -> str | None:
    """The script that most letters are of, by the first word of their names."""
    text = "".join(sequence)
    if not BEYOND_LATIN.search(text):
        return None if text.isdigit() or not text else "LATIN"
    counts = Counter(unicodedata.name(c, "?").split()[0] for c in text if c.isalpha())
    return counts.most_common(1)[0][0] if counts else None


class SuffixAutomaton:
    """All runs of words of a prompt, in linear size."""

    def __init__(self, sequence: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in sequence:
            state = self._new(self.length[last] + 1, {})
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                if self.length[at] + 1 == self.length[to]:
                    self.link[state] = to
                else:
                    twin = self._new(self.length[at] + 1, dict(self.next[to]))
                    self.link[twin] = self.link[to]
                    while at >= 0 and self.next[at].get(word) == to:
                        self.next[at][word] = twin
                        at = self.link[at]
                    self.link[to] = self.link[state] = twin
            else:
                self.link[state] = 0
            last = state

    def _new(self, length: int, arcs: dict[str, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, sequence: list[str], least: int) -> list[bool]:
        """For each word, whether it lies in a run of ``least`` or more of the prompt."""
        marks = [False] * len(sequence)
        state = run = 0
        done = 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if word in self.next[state]:
                state, run = self.next[state][word], run + 1
            else:
                run = 0
            if run >= least:
                for k in range(max(done, i - run + 1), i + 1):
                    marks[k] = True
                done = i + 1
        return marks


class DefectFinder:
    """Finds the defect of one pair; built once a task."""

    def __init__(self, terms: list[str]) -> None:
        self.labels = {" ".join(words(t)) for t in terms} - {""}
        self.prefixes = {" ".join(words(t))[:k] for t in terms for k in range(1, len(" ".join(words(t))))}
        self.refusals = ahocorasick.Automaton()
        for phrase in DECLINING:
            self.refusals.add_word(f" {phrase} ", False)
        for phrase in REFUSALS:
            self.refusals.add_word(f" {phrase} ", True)
        self.refusals.make_automaton()
        stop: dict[str, set[str]] = {}
        for language, listed in STOPWORDS.items():
            for word in listed.split():
                if len(word) > 1:  # single letters may name options
                    stop.setdefault(word, set()).add(language)
        self.stop = {word: frozenset(languages) for word, languages in stop.items()}

    def votes(self, sequence: list[str]) -> Counter:
        """How many stopwords belong to each set of languages."""
        return Counter(filter(None, map(self.stop.get, sequence)))

    @staticmethod
    def _lead(votes: Counter, one: str, other: str) -> bool:
        """Whether a text is rather in one language than in the other, by their own words: two
        and half as many again, or a single one where three more fit and none is the other's."""
        mine = sum(n for languages, n in votes.items() if one in languages and other not in languages)
        theirs = sum(n for languages, n in votes.items() if other in languages and one not in languages)
        both = sum(n for languages, n in votes.items() if one in languages and other in languages)
        return mine >= max(2, 1.5 * theirs) or (mine == 1 and not theirs and both >= 3)

    def other_language(self, asked: list[str], said: list[str]) -> bool:
        """Whether an answer has another script than the question, or is rather in a language
        that the question can't be in than in any that it can."""
        script, other = _script(asked), _script(said)
        if script and other and script != other:
            return True
        replied = self.votes(said)
        if not replied:
            return False
        votes = self.votes(asked)
        total = dict.fromkeys(STOPWORDS, 0)
        for languages, n in votes.items():
            for language in languages:
                total[language] += n
        most = max(total, key=total.get)
        if total[most] < 2:
            return False
        possible = {language for language in STOPWORDS if not self._lead(votes, most, language)}
        return any(all(self._lead(replied, language, p) for p in possible) for language in STOPWORDS if language not in possible)

    @staticmethod
    def options(question: str) -> dict[str, str]:
        """Letter and text of the options, in the running order of the letters."""
        marks, want = [], "A"
        for m in OPTION.finditer(question):
            if m[1].upper() == want:
                marks.append(m)
                want = chr(ord(want) + 1)
        ends = [m.start() for m in marks[1:]] + [len(question)]
        return {m[1].upper(): " ".join(words(question[m.end() : e])) for m, e in zip(marks, ends, strict=True)} if len(marks) > 1 else {}

    @staticmethod
    def ends(question: str, options: dict[str, str]) -> set[str]:
        """What the last option may be, as the question may go on behind it: its text up to a
        mark or to a word with a capital; up to any word where the question has one case only."""
        if not options:
            return set()
        last = [m for m in OPTION.finditer(question) if m[1].upper() == max(options)][-1]
        text = question[last.end() :]
        one_case = question in (question.upper(), question.lower())
        borders = [m.start() for m in (ANY_WORD if one_case else GOES_ON).finditer(text)]
        return {" ".join(words(text[:b])) for b in borders} - {""}

    def find(self, task: str | None, question: str | None, answer: str | None) -> str | None:
        if answer is None:
            return "empty"
        task, question = task or "", question or ""
        said = words(answer)
        boxes = "detection" in task
        if not said:
            shown = "".join(c for c in answer if not c.isspace() and unicodedata.category(c)[0] != "C")
            return None if boxes and shown in ("[]", "{}", "[[]]") else "empty"
        text = " ".join(said)
        options = self.options(question) if task == "classification" or not task else {}
        ends = self.ends(question, options)
        if text in options.values() or text in ends or (len(said) == 1 and said[0].upper() in options):
            return None
        if text in PLACEHOLDERS and text not in self.labels:
            return "empty"
        if self._refuses(answer) and not self._answers(task, answer, options):
            return "refusal"
        stated = STATED.search(answer.strip()) if options else None
        if stated and stated[1] in options and (" ".join(words(stated[2])) in ("", options[stated[1]]) or stated[1] == max(options) and " ".join(words(stated[2])) in ends):
            replied = True
        else:
            replied = bool(options and (m := REPLY_LETTER.search(answer)) and m[1] in options)
        if not replied and self._copied(question, said):
            return "copied_question"
        listed = "multi label" in task and all(" ".join(words(p)) in self.labels for p in re.split(r";\s+", answer))
        if not listed and self.other_language(words(question), said):
            return "other_language"
        return None if replied else self._broken(task, answer, said, options, stated)

    def _refuses(self, answer: str) -> bool:
        """Whether a clause refuses by itself, or declines an act of answering."""
        if next(self.refusals.iter(f" {_bare(answer)} "), None) is None:
            return False
        for clause in CLAUSE.split(answer):
            bare = f" {_bare(clause)} "
            for last, alone in self.refusals.iter(bare):
                if alone:
                    return True
                tail = bare[last:].split()
                denied = bare[: last + 1].rsplit(None, 1)[-1] not in NEEDS_DENIAL or DENIALS & set(tail)
                if denied and any(word.startswith(act) for word in tail for act in ACTS):
                    return True
        return False

    def _answers(self, task: str, answer: str, options: dict[str, str]) -> bool:
        """Whether a sentence besides those that decline answers: it holds what the task asks
        for, or does not explain the refusal."""
        for sentence in SENTENCE.split(answer):
            said = words(sentence)
            if not said or self._refuses(sentence):
                continue
            text = f" {' '.join(said)} "
            if options:
                stated = STATED.search(sentence.strip()) or REPLY_LETTER.search(sentence) or LETTER.search(sentence.strip())
                shown = bool(stated and stated[1] in options) or any(f" {o} " in text for o in options.values())
            elif "multi label" in task:
                shown = any(f" {o} " in text for o in self.labels)
            else:
                shown = any(c.isdigit() for c in sentence)
            if shown or not EXPLAINING & set(_bare(sentence).split()):
                return True
        return False

    @staticmethod
    def _copied(question: str, said: list[str]) -> bool:
        asked = words(question)
        if len(asked) < 2 or len(said) < 2:
            return False
        known = LEADS.union(asked)
        if any(w not in known for w in said):  # such a word is covered by no run
            return False
        least = min(COPIED_RUN, len(asked))
        marks = SuffixAutomaton(asked).covered(said, least)
        n = sum(marks)
        if n < least or any(not m and w not in LEADS for m, w in zip(marks, said, strict=True)):
            return False
        sentences = [len(words(s)) for s in re.split(r"[.?!:;\n]+", question)]
        return n >= min([s for s in sentences if s >= 4] or [len(asked)])

    def _broken(self, task: str, answer: str, said: list[str], options: dict[str, str], stated) -> str | None:
        bare = answer.strip()
        # Boxes may come after a lead; other answers are lists from their first character only.
        opened = re.search(r"[\[{]", bare) if "detection" in task else re.match(r"[\[{]", bare)
        if opened:
            stack = []
            for c in bare[opened.start() :]:
                if c in "[{":
                    stack.append(c)
                elif c in "]}" and (not stack or stack.pop() + c not in ("[]", "{}")):
                    return "truncated"
            if stack or not opened.start() or bare.rstrip(".!")[-1] in "]}":
                return "truncated" if stack else None
        ended = bool(END.search(bare))
        if "report" in task:
            last = bare.rsplit("\n", 1)[-1].strip().lower()
            return None if ended or last == "end of report" else "truncated"
        if "multi label" in task:
            pieces = [" ".join(words(p)) for p in re.split(r";\s+|\s*\|\s*|\n", bare)]
            if bare[-1] in ",;|/+&" or not pieces[-1]:
                return "truncated"
            if ended or pieces[-1] in self.labels or " ".join(said) in self.labels:
                return None
            last = " ".join(words(re.split(r"[,;|/\n]", bare)[-1]))
            cut = pieces[-1] in self.prefixes or (last in self.prefixes and last not in self.labels)
            return "truncated" if cut else self._hanging(ended, said)
        if options:
            tail = " ".join(words(stated[2])) if stated else " ".join(said)
            if ended or any(f" {tail}".endswith(f" {o}") for o in options.values()):
                return None
            if stated and stated[1] in options:
                # A sentence that states the option ends with a mark; the bare option doesn't.
                cut = bool(tail) and (stated.start(1) > 1 or options[stated[1]].startswith(tail))
                return "truncated" if cut else self._hanging(ended, said)
            if any(self._cut_option(tail, o) for o in options.values()):
                return "truncated"
            return self._hanging(ended, said, free=True)
        if task in ("cell counting", "counting", "regression"):
            if not any(c.isdigit() for c in answer):
                return None if ended or len(said) < 2 else "truncated"
            return self._hanging(ended, said)
        return self._hanging(ended, said, free=len(said) > 5)

    @staticmethod
    def _cut_option(tail: str, option: str) -> bool:
        """Whether the text ends with the beginning of an option, cut within it."""
        return option.startswith(tail) or any(tail.endswith(f" {option[:k]}") for k in range(4, len(option)))

    @staticmethod
    def _hanging(ended: bool, said: list[str], free: bool = False) -> str | None:
        return "truncated" if not ended and (said[-1] in HANGING or free and len(said) > 3) else None


def broken_pairs(df: DataFrame, terms: DataFrame, *, id_col: str = "pred_id") -> DataFrame:
    """(id, defect) of the defective pairs."""
    rows = terms.select("term").where("term IS NOT NULL").distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} labels")
    labels = df.sparkSession.sparkContext.broadcast([r["term"] for r in rows])  # at most MAX_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = DefectFinder(labels.value)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("task", "q", "a"))
            found = pa.array([finder.find(t, q, a) for t, q, a in zip(*columns, strict=True)], pa.string())
            rows = pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "defect"])
            yield rows.filter(found.is_valid())

    pairs = df.select(
        F.col(id_col).alias("id"), category(F.col("TaskType")).alias("task"), F.col("Question").alias("q"), F.col("Answer").alias("a")
    )
    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"id {kind}, defect string").withColumnRenamed("id", id_col)


def defect_report(df: DataFrame, defects: DataFrame, *, id_col: str = "pred_id") -> DataFrame:
    """Per model and task: pairs, defective pairs of each kind."""
    return (
        df.select(F.col(id_col), "model", category(F.col("TaskType")).alias("task"))
        .join(defects, id_col, "left")
        .groupBy("model", "task", F.coalesce("defect", F.lit("none")).alias("defect"))
        .agg(F.count("*").alias("n_pairs"))
    )
