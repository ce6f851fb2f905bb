"""Line-first cleaning.

Each line is judged by rules of three kinds; failing lines are removed, and the document is rejected when too much of
its text went with them:

* punctuation: a line of prose ends in a terminal mark (a long one has one at least), and few of its words carry runs of symbols;
* navigation: lines chopped up by separators, or short lines made of menu words;
* boilerplate: licence, copyright, consent and subscription phrases, shouted lines, one word repeated over and over,
  and lines that the document already had.

Phrases and menu words are listed for English, German, French and Spanish; a pattern looks at a bounded stretch from each place, so a
line of any length takes time in proportion.

Documents are also measured as a whole (words, symbols, repeated lines, repeated three-word windows); too short or
too repetitive ones are rejected before their lines are looked at.

Everything is a pure function of one row, run over Arrow batches that are cut to a few megabytes of text: no shuffle,
no state, memory bounded by the largest single text. Null text counts as empty: no words, rejected as too short.
Repeated rows are judged alike; extra columns pass through ``clean_lines`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

_TERMINAL = frozenset(".!?…。！？")
_CLOSERS = "\"'’”»)] \t"
_SYMBOL_RUN = re.compile(r"[^\w\s.,;:!?'\"’“”()«»¿¡-]{2,}")
_SEPARATOR = re.compile(r"[|»•›>/~·]")
_SEPARATORS = re.compile(r"(?:^|\s)[|»•›>/~·](?=\s|$)")
#: Phrases of licences, copyright, consent and subscription, by language. Each is tried on lines of any language.
PHRASES = {
    "en": (r"licen[sc]ed under", r"all rights reserved", r"under the [\w ]{0,80}licen[sc]e", r"is licen[sc]ed", r"copyright", r"privacy policy", r"terms of (?:use|service)", r"(?:uses?|accept(?: all)?) cookies", r"subscribe to", r"sign up for", r"click here", r"enable javascript"),
    "de": (r"alle rechte vorbehalten", r"lizenziert unter", r"urheberrecht\w{0,20}", r"datenschutzerklärung", r"nutzungsbedingungen", r"cookies (?:akzeptieren|zulassen)", r"verwendet cookies", r"newsletter abonnieren", r"hier klicken", r"klicken sie hier", r"javascript aktivieren"),
    "fr": (r"tous droits réservés", r"sous licence", r"droits? d[’']auteur", r"politique de confidentialité", r"conditions d[’']utilisation", r"accepter (?:tous )?les cookies", r"utilise des cookies", r"abonnez-vous", r"cliquez ici", r"activez javascript"),
    "es": (r"todos los derechos reservados", r"bajo (?:la )?licencia", r"derechos de autor", r"política de privacidad", r"condiciones de uso", r"aceptar (?:todas )?las cookies", r"utiliza cookies", r"suscríbe(?:te|se) a", r"haga clic aquí", r"haz clic aquí", r"active javascript"),
}
_BOILERPLATE = re.compile(r"©|\b(?:" + "|".join(p for of in PHRASES.values() for p in of) + r")\b")
#: One of these is in every phrase.
_CUES = ("licen", "lizenz", "recht", "rights reserved", "copyright", "©", "privacy policy", "terms of", "cookies", "subscribe", "sign up", "click here", "javascript", "datenschutz", "nutzungsbed", "newsletter", "klick", "droits", "confidentialité", "conditions d", "abonnez", "cliquez", "derechos", "privacidad", "condiciones de", "suscríbe", "clic aquí")
#: Words of menus, by language.
MENU = {
    "en": "home login logout register contact about sitemap menu search next previous back top skip help faq cart account share tweet print rss",
    "de": "startseite anmelden abmelden registrieren kontakt impressum suche suchen weiter zurück hilfe warenkorb konto teilen drucken",
    "fr": "accueil connexion déconnexion inscription recherche suivant précédent retour aide panier compte partager imprimer",
    "es": "inicio acceder salir registro contacto buscar siguiente anterior volver ayuda carrito cuenta compartir imprimir",
}
_MENU = frozenset(" ".join(MENU.values()).split())


@dataclass(frozen=True)
class LineRules:
    """min_words: shorter lines need no verdict on shouting or repetition. prose_words: a line so long may end without
    a terminal mark if it has one inside. The shares are 0 to 1."""

    min_words: int = 5
    prose_words: int = 12
    max_symbol_words: float = 0.3
    max_separators: float = 0.15
    max_upper: float = 0.7
    max_same_word: float = 0.5
    max_removed: float = 0.5
    min_base_words: int = 50
    max_repeat_percent: int = 50


RULES = LineRules()


def line_fault(line: str, rules: LineRules = RULES) -> str | None:
    """The first rule that the line fails: punctuation, navigation or boilerplate; None for a good line."""
    words = line.split()
    if not words:
        return None
    n, cut = len(words), len(_SEPARATORS.findall(line)) if _SEPARATOR.search(line) else 0
    if cut >= 2 and cut > rules.max_separators * n or n <= 8 and 2 * sum(w.strip(".,:|").lower() in _MENU for w in words) > n:
        return "navigation"
    low = line.lower()
    if any(map(low.__contains__, _CUES)) and _BOILERPLATE.search(low):
        return "boilerplate"
    if _SYMBOL_RUN.search(line) and sum(map(bool, map(_SYMBOL_RUN.search, words))) > rules.max_symbol_words * n:
        return "punctuation"
    if n >= rules.min_words and (sum(map(str.isupper, words)) > rules.max_upper * n or sum(map(eq, words, words[1:])) > rules.max_same_word * n):
        return "boilerplate"
    if line.rstrip(_CLOSERS)[-1:] in _TERMINAL or n >= rules.prose_words and not _TERMINAL.isdisjoint(line):
        return None
    return "punctuation"


def clean_text(text: str | None, rules: LineRules = RULES) -> tuple[str, float]:
    """The text without failing lines, and the share of its non-blank characters that went."""
    seen: set[str] = set()
    kept, total, gone = [], 0, 0
    for line in (text or "").split("\n"):
        bare = line.strip()
        total += len(bare)
        if bare and (bare in seen or line_fault(bare, rules)):
            gone += len(bare)
        else:
            kept.append(line)
        seen.add(bare)
    return "\n".join(kept), gone / total if total else 0.0


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more, the first included."""
    if len(words) < 4:
        return 0
    ids: dict = {}
    w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, len(words))
    if len(ids) == len(words):
        return 0
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + w[2:]
    in_order = np.sort(windows)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def judge(text: str | None, rules: LineRules = RULES) -> tuple[int, int, int, int, int, bool, bool]:
    found = measure(text)
    failed = found[0] < rules.min_base_words or 100 * found[4] > rules.max_repeat_percent * found[0]
    return *found, failed, not failed and clean_text(text, rules)[1] <= rules.max_removed


VERDICT = [("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"), ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"), ("base_failed", pa.bool_(), "boolean"), ("kept", pa.bool_(), "boolean")]


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = RULES) -> DataFrame:
    """id, measures, base_failed and kept, for every document."""

    def run(batches):
        for batch in slices(batches, text_col):
            rows = list(zip(*[judge(t, rules) for t in batch.column(text_col).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(list(v), k) for v, (_, k, _) in zip(rows, VERDICT)]], [id_col, *[n for n, _, _ in VERDICT]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} {k}" for n, _, k in VERDICT))


def clean_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = RULES) -> DataFrame:
    """The documents that stay, with failing lines removed from their text; every other column as it was."""

    def run(batches):
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            keep = pa.array([judge(t, rules)[-1] for t in texts], pa.bool_())
            cleaned = pa.array([clean_text(t, rules)[0] for t in texts], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), cleaned).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op5_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))
