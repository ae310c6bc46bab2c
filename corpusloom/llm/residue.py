"""Problem 4: template residue and error-page text.

Trusted labels come from rules over single lines: placeholders left in running text, unset values printed as words, filler,
stock titles, messages of servers and programs, notices that scripts are needed. Code spans, fenced blocks and quoted
placeholders explain such things and are passed over, as is prose about them, which is longer than a message.

Rows that are residue as a whole lend their label to near-duplicates, whose sets of five-word shingles are SIMILAR or more. Two such
sets of hashes, sorted, share one of their first elements (prefix filter: of n shingles the least n - ceil(SIMILAR n) + 1), so a join
by these finds every pair. The set whose prefix ends first shares with the other just what the prefixes share and at most all
that follows; pairs for which that is too little are dropped, the others' shingles compared; labels then spread from row to row through the connected
components until none is new. A row that only holds a placeholder in its text lends nothing, as its near-duplicates may be whole.

Null and empty values are no cases. Equal duplicate rows count once. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import bisect
import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernel as K
from corpusloom.llm.stream import map_batches
from corpusloom.plans.shared import materialize

RUN, SIMILAR = 5, 0.8
_ID = r"[A-Za-z][\w.\-]*"
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{1,80}%\}|<%[^<>\n]{1,80}%>|[$#]\{[^{}\n]{1,60}\}|\{\$[^{}\n]{1,60}\}|%\([A-Za-z_]\w*\)[sdif]"
    r"|%%[A-Za-z_]\w*%%|(?<![\w_])__[A-Z][A-Z0-9_]*__(?![\w_])|@@[A-Za-z_]\w*@@|\*\|[A-Z][\w:]*\|\*|\$\([A-Z_]{2,}\)|\[\[" + _ID + r"\]\]"
    r"|\[(?:INSERT|TODO|ENTER|YOUR|ADD|REPLACE)\b[^\[\]\n]{0,60}\]|\[[^\[\]\n]{0,50}\bgoes here\]|<(?:YOUR|INSERT|ENTER)\b[^<>\n]{0,50}>"
    r"|<[A-Z][A-Z0-9_\- ]*PLACEHOLDER>|%!\w\(<?[\w.]+>?\)|\[object [A-Z]\w+\]|(?<![\w{$#])\{\d{1,2}\}(?![\w}])"
)
_TRIGGER = re.compile(r"\{[{%$\d]|<%|[$#]\{|%\(|%%|__[A-Z]|@@|\*\||\$\(|\[\[|\[(?:INSERT|TODO|ENTER|YOUR|ADD|REPLACE)|goes here|<YOUR|<INSERT|<ENTER|PLACEHOLDER|%!|\[object ")
_UNSET = r"(?:undefined|null|NaN|None|nil|\(null\))"
UNSET_VALUE = re.compile(rf"(?:\S[^|]{{0,60}}\s[|–—-]\s)?{_UNSET}(?:\s[|–—-]\s[^|]{{1,60}})?")
UNSET_TEXT = re.compile(
    rf"\b(?:dear|hello|hi|welcome to|written by|posted by|published by|contact|last updated|for readers in|bonjour|hallo|hola|publié par|verfasst von|publicado por)[ :]+{_UNSET}(?![\w-])", re.I
)
# Words of sentences; filler of pseudo-Latin has none of them.
COMMON = frozenset("the and of in for how why is are was that which with as to by an a und der die das ist mit für im le la les des une un est pour que dans y el los las en con una para por explained".split())
# The vocabulary of filler: the passage that is always copied, words of generators, and made-up words in their manner.
LATIN = frozenset(
    """lorem ipsum dolor dolore dolores doloris sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor tempus incididunt ut labore laborum et magna aliqua aliquam enim ad minim
    veniam quis nostrud exercitation ullamco laboris nisi nisl aliquip ex ea commodo consequat duis dui aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla nullam pariatur excepteur sint
    occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est a ac at ante arcu augue auctor bibendum blandit condimentum congue convallis cras cubilia curabitur curae cursus dapibus
    diam dictum dictumst dignissim donec egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus felis fermentum feugiat fringilla fusce gravida habitant habitasse hac
    hendrerit iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas malesuada massa mattis mauris metus mi molestie mollis morbi nam nec neque netus
    nibh nunc odio orci ornare pellentesque pharetra phasellus placerat platea porta porttitor posuere potenti praesent pretium primis proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien
    scelerisque sem semper senectus sociis sodales sollicitudin suscipit suspendisse taciti tellus tincidunt tortor tristique turpis ultrices ultricies urna varius vehicula vel venenatis vestibulum vitae
    vivamus viverra volutpat vulputate lectum nibhum tantor tortis glavus fermis velum ornate ultra sedat""".split()
)
_ENDINGS = ("um", "us", "is", "ae", "am", "em", "it", "at", "et", "or", "ur", "nt", "os", "que")
PROSE = (COMMON | frozenset("that this it its be been has have had not or no you your we our they their from can will but about into once when where what then than every each l d qu il elle ce cette ces du au aux sur avec par sont ne pas se son sa ses ein eine einer einem einen den dem des zu auf nicht auch sich wird werden wie bei oder aus del al que por su sus se no es son como más o lo".split())) - LATIN
_LONG_LATIN = tuple(sorted(w for w in LATIN if len(w) >= 5))
_THREE = re.compile(r"[\W\d_]*([^\W\d_]+)[\W\d_]+([^\W\d_]+)[\W\d_]+([^\W\d_]+)")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")
_QUOTED_RUN = re.compile(r"(`+)[^`]*\1|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"")

_CODE = r"(?:4\d\d|5\d\d)"
_STATUS = r"(?:page not found|not found|bad gateway|forbidden|unauthorized|internal (?:server )?error|(?:service|server) (?:temporarily )?unavailable|gateway time-?out|bad request|gone|too many requests|method not allowed|access denied|server error|page introuvable|introuvable|du serveur|accès refusé|interdit|(?:die )?seite (?:wurde )?nicht gefunden|nicht gefunden|serverfehler|zugriff verweigert|(?:no se encontró la )?página(?: no encontrada)?|no encontrad[oa]|del servidor|acceso denegado)"
MESSAGE = re.compile(
    "|".join(
        [
            rf"(?:http(?: error)?|error|fehler|erreur|status|server error|erreur http|código)\s*(?:code\s*)?[:#]?\s*{_CODE}(?:\s*[:–—-]?\s*{_STATUS})?(?: \| .{{1,60}})?\.?",
            rf"{_CODE}\s*[:–—|-]?\s*(?:error\s*[:–—-]?\s*)?{_STATUS}(?: \| .{{1,60}})?\.?",
            rf"(?:{_CODE} )?(?:page|seite|página) (?:not found|introuvable|nicht gefunden|no encontrada)(?: [|–-] .{{1,60}})?[.!]?",
            r"no se encontró la página\.?|cette page (?:est introuvable|n[’']existe pas)\.?|(?:die|diese) seite (?:wurde nicht gefunden|existiert nicht)\.?|this page (?:could not be found|does(?: not|n[’']t) exist)\.?",
            r"traceback \(most recent call last\):?|\s*file \".{1,200}\", line \d+(?:, in .{1,80})?|(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)(?:: .{0,160})?",
            r"(?:php )?(?:fatal|parse|syntax|runtime|compile) error\b.{0,160}|(?:php )?(?:warning|notice|deprecated): .{1,120} on line \d+.{0,20}|uncaught .{0,140}|unhandled exception.{0,140}|exception in thread .{0,140}|segmentation fault.{0,40}|panic: .{0,140}|\s*at [\w.$<>]+\([\w.]+(?::\d+)?\)",
            r"(?:access denied|permission denied|zugriff verweigert|accès refusé|acceso denegado)\b.{0,120}|you (?:do not|don[’']t) have permission .{0,100}",
            r"(?:the )?(?:service|server|site|website)(?: \S+)? (?:is )?(?:temporarily |currently )?(?:unavailable|overloaded|not available|not responding|down)\b.{0,80}",
            r"(?:der|die|das) (?:dienst|server|seite|webseite)(?: \S+)? (?:ist )?(?:zurzeit|derzeit|momentan|vorübergehend|aktuell) (?:nicht (?:erreichbar|verfügbar)|überlastet).{0,60}|(?:der|die|das) (?:dienst|server)(?: \S+)? (?:antwortet nicht|ist nicht (?:erreichbar|verfügbar)).{0,60}",
            r"le (?:serveur|service|site)(?: \S+)? (?:ne répond pas|est (?:temporairement |actuellement )?(?:indisponible|surchargé|inaccessible)).{0,60}",
            r"el (?:servidor|servicio|sitio)(?: \S+)? (?:no (?:está disponible|responde)|está (?:temporalmente )?(?:fuera de servicio|saturado|caído)).{0,60}",
            r"(?:oops|whoops|ups|oups|vaya)\b.{0,80}|(?:sorry, )?something went wrong.{0,60}|(?:an|a) (?:unexpected |internal |fatal )?error (?:has )?(?:occurred|happened).{0,60}|une erreur (?:est survenue|s[’']est produite).{0,60}|(?:es|ein fehler) ist (?:ein fehler )?aufgetreten.{0,60}|etwas ist schiefgelaufen.{0,40}|(?:algo salió mal|se (?:ha producido|produjo) un error|ha ocurrido un error).{0,60}",
            r"(?:could|can) ?not connect to .{1,80}|unable to connect.{0,80}|(?:error establishing|failed to (?:open|establish)) a (?:database )?connection.{0,60}|connection (?:refused|timed out|reset|closed).{0,60}|database (?:connection )?error.{0,60}|sqlstate\[.{0,120}",
            r"the (?:requested |)(?:url|address|page|resource|file)\b.{0,60}\b(?:was not|could not be|cannot be) found.{0,60}|l[’']adresse demandée .{0,60}|die angeforderte (?:adresse|seite|url) .{0,60}|la (?:dirección|página|url) solicitada .{0,60}",
            r"(?:please )?try again (?:later|in \d+ (?:seconds|minutes))\.?",
        ]
    ),
    re.I,
)
_SCRIPT = r"(?:java ?script|scripts?|skripte?|scripting)"
NOTICE = re.compile(
    "|".join(
        [
            rf"(?:please |you must |you need to |to continue,? )?(?:enable|activate|allow|turn on|switch on|unblock) (?:your browser[’']s )?(?:\w+ )?{_SCRIPT}\b.{{0,80}}",
            rf"(?:please |you must |you need to )?.{{0,20}}\b(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b.{{0,80}}",
            rf"(?:it (?:looks like|seems) )?{_SCRIPT} (?:is|are|has been|must be|needs to be|appears to be) (?:currently |turned )?(?:disabled|off|required|needed|blocked|enabled|not enabled|switched off)\b.{{0,90}}",
            rf"(?:this|our|the) (?:app|application|page|site|website|service)\b.{{0,20}} (?:needs|requires|works only with|does(?: not|n[’']t) work without|uses) {_SCRIPT}\b.{{0,90}}",
            rf"(?:without|ohne|sans|sin) (?:\S+ )?{_SCRIPT}\b.{{0,30}}\b(?:can(?:not|[’']t)?|will|kann|können|wird|funktioniert|ne peut|ne fonctionne|impossible|no (?:se )?(?:puede|funciona))\b.{{0,80}}",
            rf"(?:your browser|you) .{{0,30}}{_SCRIPT}.{{0,40}}(?:disabled|turned off|blocked|not support).{{0,40}}",
            rf"(?:veuillez |merci d[’']|pour continuer, )?(?:activer|activez|autoriser|autorisez) {_SCRIPT}\b.{{0,80}}|(?:cette (?:application|page)|ce site) (?:exige|nécessite|requiert|a besoin d\w*) (?:les |des |de )?{_SCRIPT}\b.{{0,80}}|(?:les )?{_SCRIPT} (?:est|sont) (?:désactivé|bloqué|requis|nécessaire)\w*.{{0,60}}",
            rf"(?:bitte )?(?:schalten|aktivieren|erlauben) sie {_SCRIPT}\b.{{0,80}}|{_SCRIPT} (?:ist|sind|muss|müssen) .{{0,20}}(?:deaktiviert|ausgeschaltet|aktiviert|erforderlich|blockiert|nötig).{{0,60}}|(?:diese|die) (?:anwendung|app|seite|website) (?:benötigt|braucht|erfordert|verlangt) {_SCRIPT}\b.{{0,80}}",
            rf"(?:por favor,? )?(?:active|activa|habilite|habilita|permita) {_SCRIPT}\b.{{0,80}}|est[ae] (?:aplicación|página|sitio)(?: web)? (?:necesita|requiere|exige) {_SCRIPT}\b.{{0,80}}|(?:los )?{_SCRIPT} (?:está|están) (?:desactivad|deshabilitad|bloquead)\w+.{{0,60}}",
            r"(?:just a (?:second|moment|sec)\b.{0,20})?checking your browser.{0,100}|just a (?:second|moment)\W{0,4}|(?:please )?(?:verify|confirm|verifying|checking) (?:that )?(?:if )?(?:you are|you[’']re|the site connection is) .{0,80}|(?:un instant|einen moment|un momento)\b.{0,20}(?:navigateur|browser|navegador).{0,60}|(?:vérification de votre navigateur|ihr browser wird (?:geprüft|überprüft)|comprobando (?:su|tu) navegador).{0,80}",
        ]
    ),
    re.I,
)
FILLER = re.compile(
    "|".join(
        [
            r"(?:sample|dummy|placeholder|filler|example) (?:\S+ ){0,3}(?:text|copy|block|content|paragraph)\b.{0,20}(?:to be|will be|replace|before launch|goes here|,).{0,60}",
            r"this is (?:a|an|some) (?:sample|dummy|placeholder|example|filler) .{1,60}(?:click|replace|change|edit|delete|remove|block|paragraph|text)\b.{0,60}",
            r"(?:your|insert|put|add) (?:\S+ ){1,4}(?:goes |text )?here\b.{0,90}|.{1,40}\b(?:text|message|title|content|headline|warning) goes here\.?",
            r"coming soon: .{1,100}|.{1,60}\bcopy to be supplied\b.{0,40}|replace this (?:paragraph|text|sentence)\b.{0,80}",
            r"texte (?:fictif|d[’']exemple|factice|provisoire)\b.{1,80}|votre (?:\S+ ){1,3}ici\b.{0,90}|.{0,60}remplacez ce texte\b.{0,60}",
            r"(?:hier (?:steht|kommt) (?:ein |der |ihr |blind)).{0,90}(?:blindtext|platzhalter|ersetzen|text).{0,60}|(?:beispiel|blind|platzhalter|muster)text\b.{0,80}|ihr (?:\S+ ){1,3}hier\b.{0,80}",
            r"aquí va (?:su|tu|el|la) .{1,90}|texto (?:de (?:ejemplo|muestra|relleno|prueba)|provisional|ficticio)\b.{0,80}|.{0,60}(?:sustituya|reemplace) este texto\b.{0,60}|su (?:\S+ ){1,3}aquí\b.{0,60}",
            r"todo\b[: ]\s*\S.{0,60}|tbd|to be (?:written|done|determined)\.?|fixme\b.{0,60}",
        ]
    ),
    re.I,
)
STOCK = re.compile(
    r"(?:untitled(?: (?:document|page|post))?|new (?:page|document|post|tab)|sample page|example page|test page|default (?:web )?page|blank page|home ?page title|page title|(?:your|document|insert) title(?: here)?|title(?: goes)? here|(?:site|page|website) under construction|under construction|coming soon|hello world!?|it works!|welcome to nginx!?|index of /\S*|(?:document|page) sans titre|sans titre|site en construction|page (?:d[’']exemple|en construction)|votre titre ici|unbenannt(?:es dokument|e seite)?|ohne titel|(?:seite|website) im aufbau|beispielseite|neue seite|ihr titel hier|(?:documento|página) sin título|sin título|(?:sitio|página) en construcción|página de (?:ejemplo|muestra)|nueva página|su título aquí|nouvelle page)(?: \d{1,4})?",
    re.I,
)
_AFFIX = re.compile(r"\s+[|–—-]\s+")
_WORDS = re.compile(r"[^\W\d_]+")
# What a message, notice or filler has for certain; lines without any of them are not matched further.
_CUES = (
    "not found|introuvable|nicht gefunden|encontr|existe pas|existiert nicht|not exist|n't exist|n’t exist|traceback|, line |error:|exception|fatal error|parse error|syntax error|runtime error|compile error|on line |denied|verweigert|refusé|denegado|permission"
    "|unavailable|overloaded|not available|not responding| down|erreichbar|verfügbar|überlastet|antwortet nicht|ne répond pas|indisponible|surchargé|inaccessible|no está disponible|no responde|fuera de servicio|saturado|caído"
    "|oops|whoops|ups|oups|vaya|went wrong|error has|error occurred|error happened|est survenue|est produite|aufgetreten|schiefgelaufen|salió mal|se ha producido|se produjo|ha ocurrido|not connect|unable to connect|a connection|database connection|connection refused|connection timed|connection reset|connection closed|database error|sqlstate|try again|segmentation|panic: |uncaught|unhandled|exception in|adresse demandée|angeforderte|solicitada|bad gateway|forbidden|unauthorized|error"
    "|fehler|erreur|http|status|código|javascript|java script|scripts|skripte|script |scripting|your browser|just a |verify|verifying|confirm|navigateur|ihr browser|navegador"
    "|sample |dummy|placeholder|filler|example text|example copy| here|coming soon|copy to be|replace this|texte fictif|d’exemple|d'exemple|factice|provisoire|ce texte| ici|blindtext|platzhalter|beispieltext|mustertext|hier steht|hier kommt| hier|aquí|de ejemplo|de muestra|de relleno|de prueba|provisional|ficticio|este texto|todo|tbd|to be written|to be done|fixme"
)
_CUES = tuple(_CUES.split("|"))
_STARTS_WITH_CODE = re.compile(r"\W{0,3}[45]\d\d\b")
_MARKS = ("{", "<%", "%%", "%(", "%!", "__", "@@", "*|", "$(", "[[", "PLACEHOLDER", "goes here", "[INSERT", "[TODO", "[ENTER", "[YOUR", "[ADD", "[REPLACE", "<YOUR", "<INSERT", "<ENTER", "[object ")


@functools.cache
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _holding(words: tuple[str, ...], low: list[str], among: list[int]) -> set[int]:
    """Numbers of the lines, of those in `among`, that hold one of the words."""
    ends, at, out = [], 0, set()
    for i in among:
        at += len(low[i]) + 1
        ends.append(at)
    for end, _ in _automaton(words).iter("\n".join([low[i] for i in among])):
        out.add(among[bisect.bisect_right(ends, end)])
    return out


def _cued(low: list[str]) -> set[int]:
    """Numbers of the short lines that hold a cue."""
    short = [i for i, x in enumerate(low) if 0 < len(x) <= 240]
    return {i for i in short if _STARTS_WITH_CODE.match(low[i])} | _holding(_CUES, low, short)


def _filler_cued(low: list[str]) -> set[int]:
    """Numbers of the lines that may be filler: they hold a long word of its vocabulary, or repeat one of their first three words."""
    some = [i for i, x in enumerate(low) if x]
    return {i for i in some if (m := _THREE.match(low[i])) and len(set(m.groups())) < 3} | _holding(_LONG_LATIN, low, some)


def _pseudo_latin(words: list[str]) -> bool:
    """At least four words, no function word of a language, a quarter of the filler's vocabulary, among it a word of five letters, two thirds of a Latin look."""
    if len(words) < 4:
        return False
    known = [w for w in words if w in LATIN]
    if len(set(known)) < 2 or max(map(len, known)) < 5 or len(known) * 4 < len(words) or not PROSE.isdisjoint(words):
        return False
    return sum(w in LATIN or w.endswith(_ENDINGS) for w in words) * 3 >= len(words) * 2


def _filler_words(line: str) -> bool:
    """Pseudo-Latin as the line or one of its sentences, or a word or two over and over. All words of the line count."""
    words = _WORDS.findall(line.lower())
    if len(words) < 2:
        return False
    kinds = set(words)
    if len(words) >= 4 and len(kinds) <= 2 and len(words) * 3 <= len(line):
        return True
    # whatever is pseudo-Latin has two words of the vocabulary
    if len(kinds & LATIN) < 2 and words[0] not in ("lorem", "ipsum"):
        return False
    first = line.split(None, 1)[0].lower()
    if first.startswith(("lorem", "ipsum")) and words[0] in ("lorem", "ipsum") and (words[1] in ("ipsum", "dolor", "lorem") and words[2:3] in ([], ["dolor"], ["sit"]) or not COMMON & kinds):
        return True
    own = _QUOTED_RUN.sub(" ", line).lower()
    return _pseudo_latin(_WORDS.findall(own)) or any(_pseudo_latin(_WORDS.findall(x)) for x in _SENTENCE.split(own))


def _quoted(line: str, m: re.Match) -> bool:
    before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
    return bool(before) and before in "`\"“„«‘'‹" and bool(after) and after in "`\"”“»’'›"


def prose(text: str) -> list[str]:
    """The lines outside fenced code; a fence cut off by the text's edge counts from or to the edge."""
    lines = text.split("\n")
    if "```" not in text and "~~~" not in text:
        return lines
    fences = [i for i, x in enumerate(lines) if x.lstrip().startswith(("```", "~~~"))]
    if len(fences) % 2:
        fences = [-1, *fences] if fences[0] < len(lines) - 1 - fences[-1] else [*fences, len(lines)]
    inside = set()
    for a, b in zip(fences[::2], fences[1::2]):
        inside.update(range(a, b + 1))
    return [x for i, x in enumerate(lines) if i not in inside]


def _placeholder(line: str) -> bool:
    if not _TRIGGER.search(line):
        return False
    if "`" in line:
        line = re.sub(r"(`+)[^`]*\1", "`x`", line)
    return any(not _quoted(line, m) for m in PLACEHOLDER.finditer(line))


def _message(line: str) -> bool:
    return len(line) <= 240 and bool(MESSAGE.fullmatch(line) or NOTICE.fullmatch(line) or FILLER.fullmatch(line))


def label(field: str, value: str | None) -> tuple[bool, bool]:
    """(the value holds residue, it is residue as a whole)."""
    if not value or not value.strip():
        return False, False
    if field != "text":
        v = value.strip()
        parts = [v, *(p.strip() for p in _AFFIX.split(v))] if _AFFIX.search(v) else [v]
        if v.lower().startswith("extract: "):
            parts.append(v[9:].strip())
        whole = bool(UNSET_VALUE.fullmatch(v)) or _message(v) or any(STOCK.fullmatch(p) or MESSAGE.fullmatch(p) or NOTICE.fullmatch(p) or _filler_words(p) or FILLER.fullmatch(p) for p in parts)
        return whole or _placeholder(v), whole
    bad = size = 0
    held = False
    lines = [x.strip() for x in prose(value)]
    low = [x.lower() for x in lines]
    cued, filler = _cued(low), _filler_cued(low)
    marked, unset = any(m in value for m in _MARKS), any(m in value for m in ("undefined", "null", "NaN", "None", "nil"))
    for i, s in enumerate(lines):
        size += len(s)
        if i in cued and _message(s) or i in filler and _filler_words(s):
            bad += len(s)
        elif marked and _placeholder(s) or unset and UNSET_TEXT.search(s):
            held = True
    return bool(bad or held), bad * 2 > size


def _shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(K.grams(words, min(RUN, len(words)))) if len(words) else np.zeros(0, K.U)


def _prefix(shingles: np.ndarray) -> np.ndarray:
    """The least hashes, of which sets that are SIMILAR share one."""
    return shingles[: len(shingles) - int(np.ceil(SIMILAR * len(shingles) - 1e-9)) + 1]


def _scan(b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("field", "row_id", "cls", "size", "prefix", "held", "whole")}
    fields, ids, texts = b["field"].to_pylist(), b["row_id"].to_pylist(), b["value"].to_pylist()
    for i, j in K.batches(texts):
        w, bounds = K.words(texts[i:j])
        for t in range(i, j):
            own = w[bounds[t - i] : bounds[t - i + 1]]
            cls = int(K.signed(K.RunHash(own)(np.array([0]), np.array([len(own)])))[0]) if len(own) else 0
            shingles = _shingles(own)
            row = (fields[t], ids[t], cls, len(shingles), K.signed(_prefix(shingles)).tolist(), *label(fields[t], texts[t]))
            for name, v in zip(out, row):
                out[name].append(v)
    return out


class Residue:
    """Rows (field, row_id, value) that hold residue."""

    def __init__(self, values: DataFrame):
        self.values = values.select("field", F.col("row_id").cast("long").alias("row_id"), F.col("value").cast("string").alias("value")).where("row_id IS NOT NULL AND value IS NOT NULL AND value <> ''")
        self.rows = materialize(map_batches(self.values, _scan, "field string, row_id long, cls long, size int, prefix array<long>, held boolean, whole boolean"), "rows")
        # texts of equal words are one class; a label on one of them that is residue as a whole holds for all
        self.classes = self.rows.where("cls <> 0").groupBy("field", "cls").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.max("held").alias("held"), F.max("whole").alias("whole"), F.min("row_id").alias("row_id"))

    def _similar(self, pairs: DataFrame) -> DataFrame:
        """Pairs (field, row_a, row_b, ...) whose texts share enough five-word shingles."""
        need = pairs.select("field", F.col("row_a").alias("row_id")).unionByName(pairs.select("field", F.col("row_b").alias("row_id"))).distinct()

        def fn(b: pa.RecordBatch) -> dict:
            return {"field": b["field"], "row_id": b["row_id"], "runs": [K.signed(_shingles(K.words([t])[0])).tolist() for t in b["value"].to_pylist()]}

        runs = materialize(map_batches(self.values.join(need, ["field", "row_id"]), fn, "field string, row_id long, runs array<long>").dropDuplicates(["field", "row_id"]), "runs")
        both = pairs.join(runs.toDF("field", "row_a", "runs_a"), ["field", "row_a"]).join(runs.toDF("field", "row_b", "runs_b"), ["field", "row_b"])
        common = F.size(F.array_intersect("runs_a", "runs_b"))
        return both.where(common >= SIMILAR * (F.size("runs_a") + F.size("runs_b") - common)).select(*pairs.columns)

    def spread(self) -> DataFrame:
        """(field, cls) of the classes that a label reaches through near-duplicates, with those that lend it."""
        c = materialize(self.classes, "classes")
        keys = lambda df, *cols: df.withColumn(cols[-1], F.col("cls")).withColumn("key", F.explode("prefix")).select(*cols, F.xxhash64("field", "key").alias("key"))
        open_ = keys(c.where("NOT held"), "cls_b")
        side = lambda s: c.select("field", *(F.col(x).alias(f"{x}_{s}") for x in ("cls", "size", "row_id")), F.size("prefix").alias(f"first_{s}"), F.element_at("prefix", -1).bitwiseXOR(F.lit(-(1 << 63))).alias(f"end_{s}"))
        union = (F.col("size_a") + F.col("size_b")) / (1 + SIMILAR)
        rest = F.when(F.col("end_a") <= F.col("end_b"), F.col("size_a") - F.col("first_a")).otherwise(F.col("size_b") - F.col("first_b"))
        reached = c.where("whole").select("field", "cls")
        front = c.where("whole")
        while True:
            met = keys(front, "field", "cls_a").join(open_, "key").groupBy("field", "cls_a", "cls_b").agg(F.count("*").alias("met"))
            near = met.join(side("a"), ["field", "cls_a"]).join(side("b"), ["field", "cls_b"]).where((F.least(F.col("met") + rest, "size_a", "size_b") >= SIMILAR * union - 1e-6))
            near = near.select("field", F.col("row_id_a").alias("row_a"), F.col("row_id_b").alias("row_b"), F.col("cls_b").alias("cls"))
            near = materialize(near.join(reached, ["field", "cls"], "left_anti"), "near")
            if near.isEmpty():
                break
            new = materialize(self._similar(near).select("field", "cls").distinct(), "reached")
            if new.isEmpty():
                break
            reached = reached.unionByName(new)
            front = materialize(c.join(new, ["field", "cls"]), "front")
        return reached.distinct()

    def found(self) -> DataFrame:
        """(field, row_id) of every row that holds residue."""
        held = self.rows.where("held").select("field", "row_id")
        return held.unionByName(self.rows.join(self.spread(), ["field", "cls"]).select("field", "row_id")).distinct()

    def clean(self) -> DataFrame:
        """(field, row_id, value) of the rows without residue."""
        return self.values.join(self.found(), ["field", "row_id"], "left_anti").distinct()


def values(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The three fields as rows (field, row_id, value)."""
    part = lambda df, field, i: df.select(F.lit(field).alias("field"), F.col(i).alias("row_id"), F.col(field).alias("value"))
    return part(docs, "title", "doc_id").unionByName(part(docs, "warning", "doc_id")).unionByName(part(chunks, "text", "chunk_id"))
