"""Problem 2: broken prompt and response pairs, by a multi-label linear classifier on hashed n-grams and pair features."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.grams import clean, counted, mix, parts, within, word_hashes
from gristmill.llm.truncation import CUT, HEADING, LABELLED, LIST, SIGNED, done, ending
from gristmill.session import stored, table

DEFECTS = ["empty", "copies_question", "refusal", "other_language", "truncated"]
#: Pairs (least hashes first) from which training pairs are made; slots of hashed n-grams.
TRAIN_ROWS, SLOTS = 1600, 1 << 14
#: Share of values which are assumed to have a given defect, when a threshold is calibrated.
PRIOR = 0.05

#: Public common words by language: the evidence for a text's language among the pair features.
COMMON = {
    "de": "der die das und ist nicht mit den von zu dem ein eine einen für auf im wird nach sich auch nur bei vor des muss dass wenn ohne aus zum zur als wie noch",
    "en": "the a an of and to in is that it for on with as was by this from or be are which before until because not its so at then than each every under into without have has",
    "es": "el la los las que de y en un una por con para del se no es al lo su como más sin antes después hasta todo pero ya",
    "fr": "le la les des et est une du dans que pour pas sur avec ne par au en il qui sans ce cette plus après avant se tout jusqu à",
    "it": "il lo la gli le di e che in un una per non con sono della del dello nel alla dal più dopo prima senza tutto è ciò si ogni",
    "nl": "de het een en van is dat niet met op voor te zijn naar bij ook maar dan wordt zonder na elke",
    "pl": "i w nie na się z do jest że to jak po dla od przed przez tylko oraz",
    "pt": "o a os as que de e em um uma por com para do da não é ao no na mais sem antes depois até tudo se",
}
_LANGS = sorted(COMMON)


def _stop_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words, and the bits of their languages."""
    bits: dict[int, int] = {}
    for i, k in enumerate(_LANGS):
        for h in word_hashes(clean(pa.array([COMMON[k]])))[1].tolist():
            bits[h] = bits.get(h, 0) | 1 << i
    keys = np.array(sorted(bits), np.uint64)
    return keys, np.array([bits[int(k)] for k in keys], np.int64)


_STOPS, _STOP_BITS = _stop_table()
_QUICK = np.zeros(1 << 16, bool)
_QUICK[(_STOPS & np.uint64(0xFFFF)).astype(np.int64)] = True


def languages(row: np.ndarray, h: np.ndarray, foreign: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(language, how sure from 0 to 3) of every row's words; -1 if none speaks for any, 8 for letters that are not Latin."""
    maybe = np.flatnonzero(_QUICK[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(_STOPS, h[maybe]), len(_STOPS) - 1)
    hit = _STOPS[at] == h[maybe]
    r, bits = row[maybe][hit], _STOP_BITS[at[hit]]
    hits = np.stack([np.bincount(r[(bits >> i & 1) > 0], minlength=n) for i in range(len(_LANGS))], 1)
    order = np.sort(hits, 1)
    sure = np.digitize(order[:, -1] - order[:, -2], [1, 3, 6])
    best = np.where(sure > 0, hits.argmax(1), -1)
    words = np.bincount(row, minlength=n)
    strange = foreign > np.maximum(2, words)
    return np.where(strange, len(_LANGS), best), np.where(strange, 3, sure)


PAIR = 512
_KINDS = ("complete", "unsure", *CUT)
_QUOTED = re.compile(r"[“„«]([^”“»]{3,})[”“»]|\"([^\"\n]{3,})\"")
_STOP = re.compile(r"[.!?。][\"'”’»)\]]*(?:\s|$)")


def _tail(t: str) -> list[int]:
    """Numbers of a text's ending: below PAIR what kind it is, from PAIR on hashes."""
    t = t.rstrip()
    if not t:
        return [200]
    kind = _KINDS.index(ending(t))
    last = t[t.rfind("\n") + 1 :].strip()
    line = 1 if LIST.match(last) else 2 if HEADING.match(last) or SIGNED.match(last) else 3 if last.startswith("|") else 4 if last.endswith("```") else 0
    rest = _STOP.split(last)[-1] if line == 0 else last
    after = min(5, len(rest.split()))
    if line == 0 and LABELLED.match(rest or " "):
        line = 5
    c = t[-1]
    char = 0 if c.isalpha() else 1 if c.isdigit() else 2 if done(t) else 3 if c in "”\"'’»)]}`*_|>" else 4 if c in ",;:-–—/(“„«=" else 5
    whole = len(last) == len(t)
    i = len(last)
    while i and not last[i - 1].isalpha():
        i -= 1
    j = i
    while j and last[j - 1].isalpha():
        j -= 1
    w = hash_text(last[j:i].lower())
    quoted = sum(len(a) + len(b) for a, b in _QUOTED.findall(t)) / len(t) if not {"“", "„", "«", '"'}.isdisjoint(t) else 0.0
    return [160 + (quoted > 0) + (quoted > 0.2) + (quoted > 0.95), 201 + kind, 330 + (kind > 1), 212 + line * 6 + after, 250 + line * 6 + char, 290 + kind * 2 + whole, 312 + line * 2 + whole, PAIR + (w >> 7) % SLOTS, PAIR + (hash_text(t[-2:].lower()) >> 5) % SLOTS]


def hash_text(s: str) -> int:
    """A 64-bit hash that is the same in every process."""
    got = _HASHES.get(s)
    if got is None:
        if len(_HASHES) > 300_000:
            _HASHES.clear()
        h = 0xCBF29CE484222325
        for b in s.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        got = _HASHES[s] = (h ^ h >> 29) & 0xFFFFFFFFFFFFFFFF
    return got


_HASHES: dict[str, int] = {}


def features(texts: pa.Array, prompts: pa.Array, last_words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, slot, value, language of the text) of pairs: pair features, then hashed words and adjacent pairs of words scaled by their number; ``last_words`` adds hashes of a text's end."""
    n = len(texts)
    raw = ["" if t is None else t for t in texts.to_pylist()]
    ct, cp = clean(texts), clean(prompts)
    (rt, ht), (rp, hp) = word_hashes(ct), word_hashes(cp)
    foreign = [pc.count_substring_regex(c, r"[^\p{Latin}\P{L}]").to_numpy(zero_copy_only=False) for c in (ct, cp)]
    a, b = np.bincount(rt, minlength=n), np.bincount(rp, minlength=n)
    key, owner = counted(rt, ht)
    asked, _ = counted(rp, hp)
    shared = np.bincount(owner[within(key, asked)], minlength=n)
    (lt, st), (lp, sp) = languages(rt, ht, foreign[0], n), languages(rp, hp, foreign[1], n)
    part = lambda x, k: np.minimum(k - 1, (x * k).astype(np.int64))
    size = np.minimum(10, np.ceil(np.log2(a + 1))).astype(np.int64)
    differ = np.where((lt < 0) | (lp < 0), 0, np.where(lt == lp, 1, 2))
    copied = part(shared / np.maximum(1, np.maximum(a, b)), 25)
    fixed = np.stack(
        [
            copied,
            25 + part(shared / np.maximum(1, a), 10),
            35 + part(shared / np.maximum(1, b), 10),
            46 + size,
            60 + differ * 16 + st * 4 + sp,
            110 + differ * 11 + size,
            145 + np.minimum(4, part(foreign[0] / np.maximum(1, pc.utf8_length(ct).to_numpy(zero_copy_only=False)), 5)),
            np.where(a == 0, 150, 151),
            152 + differ,
            155 + (shared >= 0.8 * np.maximum(a, b)) * (b > 0),
        ],
        1,
    )
    tails = [_tail(t) for t in raw]
    if not last_words:
        tails = [[x for x in t if x < PAIR] for t in tails]
    # n-grams, with the text's first word as well
    slot = lambda h: PAIR + (h % np.uint64(SLOTS)).astype(np.int64)
    same = rt[1:] == rt[:-1]
    first = np.flatnonzero(np.append(True, ~same)) if len(rt) else np.zeros(0, np.int64)
    pair = mix(ht[:-1] * np.uint64(31) + ht[1:])[same]
    blocks = [
        (np.repeat(np.arange(n), fixed.shape[1]), fixed.ravel(), False),
        (np.repeat(np.arange(n), [len(t) for t in tails]), np.array([x for t in tails for x in t], np.int64), False),
        (rt, slot(ht), True), (rt[1:][same], slot(pair), True), (rt[first], slot(mix(ht[first] + np.uint64(77))), True),
    ]
    counts = [np.bincount(r, minlength=n) for r, _, _ in blocks]
    starts = np.concatenate([[0], np.cumsum(np.sum(counts, 0))]).astype(np.int64)
    cols, vals, at, scale = np.zeros(starts[-1], np.int64), np.ones(starts[-1], np.float32), starts[:-1].copy(), (1.0 / np.sqrt(1.0 + 2.0 * a)).astype(np.float32)
    for (r, c, scaled), count in zip(blocks, counts):  # each block is in order of rows
        to = np.repeat(at - np.cumsum(count) + count, count) + np.arange(len(r))
        cols[to] = c
        if scaled:
            vals[to] = scale[r]
        at += count
    return starts, cols, vals, lt


class LinearModel:
    """One logistic regression per defect over shared sparse features, fitted by mini-batches of Adagrad."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        if len(starts) == 1:
            return np.zeros((0, len(DEFECTS)), np.float32)
        return np.add.reduceat(self.weights[cols] * vals[:, None], starts[:-1]) + self.weights[-1]

    def margins(self, texts: pa.Array, prompts: pa.Array) -> np.ndarray:
        """Score less threshold of every pair and defect: 0 or more is a defect."""
        out = [self.scores(*features(texts.slice(a, b - a), prompts.slice(a, b - a))[:3]) for a, b in parts(pc.binary_join_element_wise(pc.fill_null(texts, ""), pc.fill_null(prompts, ""), ""))]
        return np.concatenate(out or [np.zeros((0, len(DEFECTS)), np.float32)]) - self.thresholds

    def defects(self, texts: pa.Array, prompts: pa.Array) -> list[str | None]:
        """The defect of the greatest margin of each pair, None for sound ones."""
        m = self.margins(texts, prompts)
        best = m.argmax(1) if len(m) else []
        return [DEFECTS[k] if m[i, k] >= 0 else None for i, k in enumerate(best)]

    @classmethod
    def fit(cls, texts: pa.Array, prompts: pa.Array, labels: np.ndarray, passes: int = 12, last_words: bool = True, size: int = 512, seed: int = 3) -> LinearModel:
        """Labels are numbers of DEFECTS, -1 for sound pairs. A fifth of the pairs calibrates the thresholds."""
        weights, thresholds = np.zeros((PAIR + SLOTS + 1, len(DEFECTS)), np.float32), np.ones(len(DEFECTS), np.float32)
        if not len(labels):  # nothing to learn from: nothing is called defective
            return cls(weights, thresholds)
        starts, cols, vals, _ = features(texts, prompts, last_words)
        y = (labels[:, None] == np.arange(len(DEFECTS))).astype(np.float32)
        held = np.arange(len(labels)) % 5 == 0
        learn = np.flatnonzero(~held)
        cost = np.where(y > 0, 0.5 / np.maximum(1, y[learn].sum(0)), 0.5 / np.maximum(1, (1 - y[learn]).sum(0))) * len(learn)
        rng, total = np.random.default_rng(seed), np.full_like(weights, 1e-3)
        model = cls(weights, thresholds)
        for _ in range(passes):
            rng.shuffle(learn)
            for lo in range(0, len(learn), size):
                rows = learn[lo : lo + size]
                count = starts[rows + 1] - starts[rows]
                at = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                c, v, first = cols[at], vals[at], np.concatenate([[0], np.cumsum(count)])
                z = model.scores(first, c, v)
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * cost[rows]).astype(np.float32) / len(rows)
                per = np.repeat(np.arange(len(rows)), count)
                grad = np.stack([np.bincount(c, v * g[per, d], len(weights)) for d in range(len(DEFECTS))], 1).astype(np.float32) + 1e-5 * weights
                grad[-1] = g.sum(0)
                total += grad * grad
                weights -= 0.3 * grad / np.sqrt(total)
        thresholds[:] = _calibrated(model.scores(starts, cols, vals)[held], y[held])
        return model


def _calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per defect the score at which a held-out pair is as likely sound as defective, a share PRIOR being so: Platt's sigmoid, which a few mislabelled pairs hardly move."""
    out = np.ones(y.shape[1], np.float32)
    for d in range(y.shape[1]):
        x, t = z[:, d].astype(np.float64), y[:, d] > 0
        pos, neg = t.sum(), (~t).sum()
        if not pos or not neg:
            continue
        goal, weight = np.where(t, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.where(t, PRIOR / pos, (1 - PRIOR) / neg)
        slope, shift = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
            g, w = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * x * x).sum() + 1e-9, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
            step = np.clip(np.linalg.solve(hess, [(g * x).sum(), g.sum()]), -2, 2)
            slope, shift = max(1e-3, slope - step[0]), shift - step[1]
        out[d] = -shift / slope
    return out


#: Parts of made refusals by language, replies that say nothing, and short sound replies: the training's synthetic values.
REFUSALS = {
    "en": [(["", "I'm sorry, but ", "Unfortunately, ", "Regrettably, ", "As an assistant ", "At this time ", "Thank you for asking, but ", "Sorry. ", "I apologise; "], ["I cannot", "I can't", "I can’t", "I won't", "I will not", "I am not able to", "I am unable to", "I must refuse to", "I must decline to", "I have to decline to", "I would prefer not to", "I am not allowed to", "I am not in a position to", "I don't feel comfortable trying to"], [" help with", " answer", " discuss", " comment on", " work on", " carry out", " give advice on", " assist with", " say anything about"], [" this", " that", " that request", " this question", " such a task", " matters like this", " the topic", " anything about {0}", " the {0}"], [".", " for policy reasons.", " under my guidelines.", ", since it could cause harm.", " because it is outside my scope."], ["", "", " I hope you understand.", " Please ask a qualified person about it.", " Is there something else you need?", " Let me know if there is another topic."]),
           (["", "", "Sorry. ", "Hello! ", "Thanks for asking. "], ["No answer can be given here", "No reply is possible on this", "Request denied", "The request is refused", "This lies outside of what I do here", "This goes beyond what I am for", "My instructions do not permit this", "My rules exclude this subject", "You should ask somebody else about it", "That is nothing I may talk about", "It would be wrong for me to reply to this", "I would sooner stay out of it", "This is against my rules, so there is no answer"], [".", "; please consult a specialist.", ". Ask something else.", ". I hope that is all right.", ". Is there another topic?"])],
    "de": [(["", "Leider ", "Es tut mir leid, aber "], ["kann ich", "darf ich", "möchte ich"], [" dabei", " diese Frage", " diese Anfrage", " das"], [" nicht beantworten", " nicht bearbeiten", " nicht helfen", " nicht unterstützen", " leider ablehnen"], ["."]), (["Diese Anfrage muss ich ablehnen.", "Dazu darf ich keine Auskunft geben.", "Eine Antwort ist mir nicht möglich."],)],
    "fr": [(["", "Malheureusement, ", "Je suis désolé, mais "], ["je ne peux pas", "je ne suis pas en mesure de", "je dois refuser de", "il m'est impossible de"], [" répondre", " traiter", " commenter", " aider"], ["", " à cette demande", " cette question", " ce sujet"], ["."])],
    "es": [(["", "Lo siento, pero ", "Por desgracia, "], ["no puedo", "no me es posible", "debo negarme a"], [" responder", " comentar", " ayudar", " tratar"], ["", " a esta solicitud", " con esta pregunta", " ese tema"], ["."])],
}
STAND_INS = ["", " ", "\n", "N/A", "n/a", "NA", "null", "None", "nil", "NaN", "TBD", "TODO", "...", "…", "-", "--", "?", "<p></p>", "<answer></answer>", "<div> </div>", "&nbsp;", "{}", "[]", "[no answer]", "(empty)", "(none)", "[blank]", "no response", "No output", "not available", "Answer:", "Response:", "Output:", "placeholder", "to be done", "​", "﻿", "```\n```", "\"\"", "."]
SHORT = ["Yes", "No", "Both", "Neither", "None of these.", "Nothing new.", "Option {1}", "{0} rows", "{0}", "{0} percent", "{0} minutes", "About {0}.", "{0}.{0} hours", "The {1} one", "It depends.", "Not yet."]
LEADS = ["", "", "", "> ", "Question: ", "Task: ", "Prompt - ", "* ", "You asked: ", "**"]


def _said(rng: random.Random, lang: str, thing: str) -> str:
    said = "".join(rng.choice(c) for c in rng.choice(REFUSALS[lang])).replace("{0}", thing)
    said = said[:1].upper() + said[1:]
    return rng.choice([said, said, said, said.lower(), f"**{said}**", f"> {said}", "Hello! " + said])


def _copied(rng: random.Random, prompt: str) -> str:
    """The prompt with a few words left out, changed, joined or marked."""
    out = []
    for w in prompt.split(" "):
        x = rng.random()
        if x < 0.03:
            continue
        if x < 0.06 and len(w) > 4:
            k = rng.randrange(1, len(w) - 2)
            w = rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "​" + w[k:], w + w[-1], w.upper()])
        out.append(w)
    t = rng.choice(LEADS) + rng.choice([" ", " ", " ", "  ", "\n", "\u00a0"]).join(out)
    return rng.choice([t, t, t, t.upper(), t.lower(), t.rstrip(".?!") + rng.choice(["", " -", "!", ";"]), t.replace(". ", ".\n* "), f"<p>{t}</p>", "  " + t + " \t"])


def synthetic(rng: random.Random, base: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """(text, prompt, defect or -1): sound pairs (prompt, text, language), and the same cut, copied, swapped, refused and emptied."""
    by_lang: dict[int, list[str]] = {}
    for _, a, k in base:
        by_lang.setdefault(k, []).append(a)
    langs = sorted(k for k in by_lang if k >= 0 and len(by_lang[k]) > 2)
    out: list[tuple[str, str, int]] = []
    for p, a, own in base:
        out.append((a, p, -1))
        body = a.rstrip()
        for low in (25, len(body) // 2, len(body) * 4 // 5):
            if len(body) > 60:
                at = rng.randrange(low, len(body) - 2)
                if body[at] != "\n" and not done(body[:at].rstrip()):
                    out.append((body[:at] + rng.choice(["", "", "", "", "...", "…", ",", " -", " [truncated]"]), p, 4))
        words = p.split()
        if words:
            if rng.random() < 0.6:
                out.append((_copied(rng, p), p, 1))
            if rng.random() < 0.3:
                out.append((rng.choice([p + "\n\n" + a, a + "\n\n" + p]), p, -1))
        others = [k for k in langs if k != own]
        if own >= 0:
            out.append((rng.choice(by_lang[own]), p, -1))  # swapped within the language: complete, if wrong
            if others:
                out.append((rng.choice(by_lang[rng.choice(others)]), p, 3))
        lang = _LANGS[own] if 0 <= own < len(_LANGS) and _LANGS[own] in REFUSALS and rng.random() < 0.8 else "en"
        thing = " ".join(words[3:5]) or "it"
        said = _said(rng, lang, thing)
        out.append((said, p, 2))
        if rng.random() < 0.3:
            out.append((" ".join(_said(rng, lang, thing) for _ in range(rng.randrange(2, 12))), p, 2))
        if rng.random() < 0.3:
            q = rng.choice(["“{}”", "\"{}\"", "«{}»"]).format(said)
            out.append((f"The reply {q} was logged. " + a, p, -1))
            out.append((rng.choice(["The tool printed {} since its setting was wrong.", "It said {} in two of three runs.", "{} is what the older version prints for {1} here.", "They quote {} as the cause."]).replace("{}", q).replace("{1}", thing), p, -1))
            out.append(("I can't see all of it from here, but the way is clear. " + a, p, -1))
        if rng.random() < 0.4:
            out.append((rng.choice(STAND_INS), p, 0))
            out.append((rng.choice(SHORT).replace("{0}", str(rng.randrange(1, 5000))).replace("{1}", rng.choice("ABCDE")), p, -1))
        if rng.random() < 0.2:
            out.append((a + rng.choice(["\n\nTotal: 5 rows", " Result = 41 units", "\n- first item\n- second item: 7 parts", "\n\n| a | b |\n|---|---|\n| x | 1 |", "\n\n```\nreturn x\n```", "\n\n## Notes", "\n-- the editors"]), p, -1))
    return out


def train(pairs: DataFrame, prompt: str, text: str, order: str, rows: int = TRAIN_ROWS, seed: int = 3) -> LinearModel:
    """Fits the model on at most ``rows`` pairs (those of the least hashes), made defective in known ways.

    The sampled pairs are taken as sound first; those that the first model calls defective are left out of the second.
    The first does without last words, so that it cannot learn the sample's own cuts by heart.
    """
    usable = pairs.where((F.length(text) > 60) & (F.length(prompt) > 20))
    share = min(1.0, 4.0 * rows / max(1, usable.count()))
    h = F.xxhash64(order, F.lit(seed))
    least = usable.where(h < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else usable
    base = [(p, a) for p, a, _ in least.select(prompt, text, h.alias("h")).orderBy("h", text).limit(rows).collect()]
    model = LinearModel.fit(pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64))
    for passes in (4, 12):
        if not base:
            break
        prompts, texts = (pa.array(c, pa.string()) for c in zip(*base))
        spoken = features(texts, prompts)[3].tolist()
        made = synthetic(random.Random(seed), [(p, a, k) for (p, a), k in zip(base, spoken)])
        t, p, y = zip(*made)
        model = LinearModel.fit(pa.array(t, pa.string()), pa.array(p, pa.string()), np.array(y), passes, passes > 4)
        if passes == 4:
            base = [b for b, m in zip(base, model.margins(texts, prompts).max(1)) if m < 0]
    return model


def broken_pairs(pairs: DataFrame, record: str, field: str, prompt: str, text: str) -> DataFrame:
    """(record, field, defect) of every value which the classifier calls defective, with its defect of the greatest margin.

    A null text is an empty one; so is a null prompt, with which nothing can be compared. Null records are left out,
    repeated rows count once, very long texts are judged whole. Too few pairs to learn from give no defects, an
    empty table no rows.
    """
    pairs = stored(pairs.where(F.col(record).isNotNull()).select(record, field, F.coalesce(prompt, F.lit("")).alias("prompt"), F.coalesce(text, F.lit("")).alias("text")))
    model = pairs.sparkSession.sparkContext.broadcast(train(pairs, "prompt", "text", record))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(model.value.defects(b.column(2), b.column(3)), pa.string())
            at = pc.indices_nonzero(pc.is_valid(found))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), found.take(at)], [record, field, "defect"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (record, field))
    return pairs.select(record, field, "text", "prompt").mapInArrow(run, f"{kinds}, defect string").distinct()


def answered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "teacher_task").groupBy("task_id").agg(F.max("prompt").alias("prompt"))
    c = table(spark, sf_dir, "candidate").select(F.col("candidate_id").alias("record_id"), F.lit("answer").alias("field"), "task_id", F.col("answer").alias("text"))
    k = table(spark, sf_dir, "critique")
    for f in ("corrected_answer", "hard_negative"):
        c = c.union(k.select(F.col("critique_id").alias("record_id"), F.lit(f).alias("field"), "task_id", F.col(f).alias("text")))
    return c.join(tasks, "task_id", "left").select("record_id", "field", "prompt", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(answered_prompts(spark, sf_dir), "record_id", "field", "prompt", "text")
