"""How one unit (a line's sentence) of a text is judged: by its syntax and by its vocabulary, not by known sentences.

Three things are looked at. *Syntax*: template delimiters, machine output, values printed into a slot. *Vocabulary*:
which share of a unit's content words belongs to what sites say about themselves (things of a site, their states, what
a visitor is asked to do) or to what forms and drafts say about themselves. *Information*: repeated words, keyboard
rows, letters unlike all the corpus. Each gives a weight below the one that makes a post residue, template
syntax apart; what the thread's title, the rest of the post and the host say decides (``residue``).
"""

from __future__ import annotations

import re
import zlib

import numpy as np

# Words that carry no content, by language.
FUNCTION_WORDS = """
a an the this that these those it its he she they them their we us our you your i me my and or but nor so if then than as of at by
for from in into on onto to with without about above after before between during over under until while up down out off is are was
were be been being am do does did has have had having will would shall should can could may might must cannot not no yes any some per seem seems yet itself yourself themselves id all both each
every either neither other another such same own too very just only also there here when where which who whom what how why because
der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren muss müssen musst wird werden wurde wurden hat
haben ich du er sie es wir ihr ihnen ihre ihren mich mir uns euch mein dein sein auf in im um an am zu zum zur von vom mit ohne für bei
nach aus über unter als wie wenn dass daß so auch nur noch schon bald dieser diese dieses diesen diesem hier dort was wer da kann
el la los las un una unos unas y o pero no es son era fue ser debe deben está están ha han he lo le les se su sus mi tu nos me te de del a al en
con sin por para como que qué si más muy ya este esta esto estos estas ese esa eso aquí hay puede cuando donde
le les une des du de et ou mais ne pas est sont doit devez était sera être a ont ai je tu il elle nous vous ils elles on ce cet cette ces son sa ses
mon ma mes votre vos notre nos au aux en dans sur sous avec sans pour par que qui quoi si plus très ici là y peut dont
"""

# Stems (with *) and words of what sites say about themselves: the things of a site ...
THINGS = """
page* site* website* webpage* homepage server* service* host hosting gateway* upstream proxy database* browser* client* navigator
account* login logon password* connection* network* request* url* link links content contents profile* forum* member* administrator* admin*
webmaster* moderator* owner* http https html api status archive* token* user users visitor* traffic address security badge*
incident* internal trace rate* mode video* image* photo* app apps application*
seite* dienst* inhalt* konto anmeld* sitzung* verbindung* netzwerk* anfrage* webseite* zugriff* berechtigung* rechte intern*
página* sitio* servidor* servicio* contenido* navegador* cuenta conexión solicitud* enlace* acceso permiso*
serveur* navigateur* contenu* compte* connexion* requête* lien* accès
"""

# ... the states it reports (scripts and cookies among them, which it asks for) ...
STATES = """
error* fail* fault* exception* unavailable* unreachable offline denied denial forbidden block* disabl* deactivat* expir* invalid missing
remov* delet* restrict* suspend* banned ban exceed* refus* maintenance outage* downtime timed overload* unauthor* unsupported require* unknown limit* moved gone
permission* access* temporar* unexpected* loading occurred awkward captcha human robot* reloads redirect* signed logged session* lost
trouble* snag* hiccup* glitch* mishap oops whoops hoppla oups apolog* unable difficult* outdated updated scheduled planned interrupted maintain* verify*
errno javascript js script scripts scripting noscript cookie*
fehler* wartung* gesperrt verweigert abgelaufen* deaktivier* aktivier* vorübergehend erforderlich benötigt störung* aufgetreten fehlen fehlt
denegad* activar habilit* mantenimiento inesperado temporal* caducad* bloquea* expirad* necesari* necesita* sesión solicitad*
erreur* refus* introuvable* indisponible* interdit* expiré* activer désactiv* momentané* temporair* inattendu* survenue
"""

# ... what is a state only where it is negated ...
ABLE = """
found shown show display* displayed loaded load open opened complete* process* available allowed permitted exist* valid supported support work* run
running reach* reached understand correct* continue see view respond* active*
gefunden geladen angezeigt verfügbar erreichbar geöffnet existiert funktioniert
disponible* encontrad* existe existen funciona admite mostrar
trouvé* trouvée fonctionne afficher
"""

# ... and ordinary words that go with them.
MANNERS = """
please sorry thank thanks patience try again retry later shortly soon slow little message wait moment* second seconds minute minutes hour* back return enable* activat* allow*
turn* switch* sign log register* contact* visit* check* confirm* proceed click browse skip use find reload* refresh* look looking longer
need needs something wrong happen* happening problem* issue* tell know known never busy many much full gave reply
update* way home main menu search start close closed window feature* appear* appears nothing sent keep keeps side team down
private protected hidden locked broken kindly setting* depend* connect* receive* until one reason code bad read stay stays empty make sure like instead several unusual
detected protect suspicious timeout went followed technical region country secure connecting notif* broke experienc* uh oh go going author* post posts thread question* answer* comment* topic* discussion* vote* tag tags resource* document*
article* item* reader option* help
bitte versuchen versuch* sehen später erneut laden warten nochmals werden öffnen sekunden minuten leider gerade derzeit momentan zurück startseite mehr
favor intente inténtelo intentar nuevo segundos minutos vuelva más tarde ver producido iniciar volver inicio usar pueden cambiado
veuillez réessayer patienter voir plus tard nouveau secondes minutes retour accueil cette produit* charger
"""

#: Turns of phrase that report a state, by their build.
STATE_RE = re.compile(r"\btoo many\b|\bretry (?:after|in) \d|^slow down\b|please slow down\b|\b(?:one moment|please wait|just a (?:moment|second))\b|^\W*(?:checking|verifying|loading|redirecting|processing|connecting|updating)\b|\bwent wrong\b|\b(?:is|are|be|was|were) (?:\w+ )?down\b|\bdown for\b|\b(?:sign|log)(?:ged|ing)? (?:in|out)\b|^\W*(?:\w+ ){0,3}\w+(?:\.{3}|…)$")
NEGATION_RE = re.compile(r"\b(?:not|no|cannot|can't|couldn't|doesn't|isn't|don't|unable|never|without|nicht|kein\w*|ohne|sin|ne|n'\w+|pas|sans)\b")
#: A site's navigation: names and nothing else between separators.
NAVIGATION_RE = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+)?(?: ?[|»>·] ?[^\W\d_]+(?: [^\W\d_]+)?){2,}$")

# What forms and drafts say about themselves.
DRAFT = """
placeholder* lorem ipsum dummy filler sample* template* caption* heading* headline* paragraph* blindtext* platzhalter* mustertext* beispieltext*
relleno provisoire provisional provisorisch* tbd tba todo body copy boilerplate draft* subtitle section* field* summary
describe* description fill filled insert* untitled text texto texte coming
"""
DRAFT_MANNERS = """
text title write enter type put paste add added delete replace* remove line here content* answer question topic short list entry message
please goes go come soon added full publish final real supplied supply follow* follows layout purpose* ignore editor below own e g example*
optional required n response later page post name example first second third one two complete detail* details words word step steps
ersetzen ersetze zeigt später aussieht steht bald richtige* text* hier folgt kommt einfügen eingeben beschreib* dies eigentliche* inhalt*
irá respuesta definitiva aquí escrib* próximamente texto describ*
remplacer vraie réponse suivra viendra écri* décri*
"""

# The stock of filler Latin, as stems.
LATIN = """
lorem ipsum dolor* sit amet consectetur* adipiscing elit* sed eiusmod tempor incididunt labor* magna* magn* aliqua* enim minim veniam quis
nostrud exercitation ullamco nisi aliquip commodo consequat duis* irure reprehenderit volupt* velit* esse cillum fugiat nulla pariatur
excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim est laborum porta* integra* integer vita* nunc* tell* fauc*
eget donec mauris vestibulum aenean pellentesque
"""

#: Template syntax that prose does not hold outside code: a pair of delimiters around a name.
TEMPLATE_RE = re.compile(
    r"\{\{.{0,60}?\}\}|\{%.{0,60}?%\}|<%=?.{0,60}?%>|[$#]\{[\w.\- |()']{1,60}\}|\{(?:[A-Za-z_][\w.]{0,40}|\d{1,2})\}|%\([\w.]{1,40}\)[sd]"
    r"|%%[\w. ]{2,40}%%|(?<![\w%])%[A-Za-z_.]{3,40}%(?!\w)|(?<!\w)__[A-Za-z][A-Za-z_.]*__(?!\w)|\[\[[\w .\-]{1,60}\]\]|«[\w .\-]{1,60}»"
    r"|@@[\w. ]{1,40}@@|<<[\w .\-]{1,60}>>|(?<!\w)\|[A-Z][A-Z_. ]{1,40}\||[\[<](?i:insert|your|enter|add|put|fill in)\b[^\]>\n]{0,60}[\]>]"
    r"|[\[<][\w .\-]{1,60} (?:goes )?here[\]>]"
)
#: A name in brackets: spoken of as often as left behind.
BRACKETED_RE = re.compile(r"[\[<](?!(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|EDIT|SOLVED|CLOSED)\b)(?:[A-Z]{2,}(?:[ _][A-Z]+){0,3}|(?i:first|last|full|user|company|product|order|site|customer|reply|post|ticket|model|tag)[ _]?\w*)[\]>]")
SALUTATION_RE = re.compile(r"^(?:dear|hi|hello|hey|bonjour|hola|hallo|liebe[r]?|cher|chère|estimad[oa]|sehr geehrte[r]?|thanks|regards|welcome)\b")
MARKS_RE = re.compile(r"[{<\[%«@|_]")

#: Values that were printed into a slot though they were empty: a salutation, a label or a subject beside them.
_VOID = r"(?:undefined|null|nan|none|nil)"
LEAK_RE = re.compile(
    rf"\[object object\]|\binvalid date\b|^(?:{_VOID}|n/a|true|false)[.!,]?$|\b(?:dear|hi|hello|hey|by|from|bonjour|hola|hallo|liebe[r]?|thanks|welcome|to|on|at|since)(?: back| again)?,? {_VOID}\b"
    rf"|^{_VOID} \w+(?:ed|t|s|e|as) (?:a|an|your|the|on|this)\b|\b\w+ ?: ?(?:undefined|null|nan|nil)\b(?! ?[;,)}}])|\byour \w+ {_VOID}\b|\b{_VOID}\b.{{0,30}}\b(?:undefined|null|nan)\b",
    re.I,
)

_VOIDS = frozenset("undefined null nan none nil object invalid n true false".split())

#: Machine output: a message with its place, a state with its number, a product with its version.
MACHINE_RE = re.compile(
    r"\b(?:at|on|in) (?:line|row) \d+|\(line \d+\)|\berrno \d+|\bin /\S+\.\w{2,4}\b|\bsqlstate\b|\b(?:unhandled|uncaught)\b.{0,20}\b(?:error|exception|request)\b|^\W*(?:php )?(?:warning|fatal(?: error)?|notice|parse error)\b ?:"
    r"|^\w+_\w+: [\w]+(?:\.\w+)+$|\w+(?:exception|error) at \w+",
    re.I,
)
_MACHINE_WORDS = frozenset("line row errno sqlstate unhandled uncaught warning fatal notice error exception".split())
TAGGED_RE = re.compile(r"^\s*<(?:html|noscript|!doctype|body|!--)", re.I)
_TAG_RE = re.compile(r"</?[a-zA-Z][^>]*>|<!--|<!doctype[^>]*>|-->")
_PATH_RE = re.compile(r"(?<!\S)/\S+\.\w+")
_BLANK_RE = re.compile(r"[\s.…_\-]{3,}|…")
#: A unit that is set apart as a form's prompt: in brackets, parentheses, underscores or a comment.
APART_RE = re.compile(r"^(?:\[[^\]]+\]|\([^)]+\)|_[^_]+_|<!--.*-->|<[^>]+>)[.:]?$")

#: Signs that a unit speaks about such text instead of being it, by how the sentence is built.
_SAYS = r"(?:says?|said|tells?|told|claims?|claimed|complains?|complained|reports?|reported|shows?|showed|answers|answered)"
_PUTS = r"(?:leaves?|left|prints?|printed|shows?|showed|displays?|displayed|renders?|rendered|says?|said|reads|inserts?|inserted|writes?|wrote|sends?|sent|contains?|keeps?|kept)"
TALK_RE = re.compile(
    "|".join(
        f"(?:{p})"
        for p in (
            r"\?\W*$",  # a question
            # the writer is the subject, or what it is about is the writer's
            r"(?<![\w.])i(?:'m|'ve|'d|'ll|’m|’ve|’d|’ll)?(?![\w.'’])",
            r"\bmy (?!(?:account|profile|dashboard|page|posts|questions|answers|settings)\b)\w+|^mine\b",
            r"\b(?:tells?|told|gives?|gave|shows?|showed|asks?|asked|lets?) me\b|\bfor me\W*$",
            # a question's opening without its mark; 'what you were looking for' opens no question
            r"^(?:(?:and|but|so|hi|hello|also|ok),? )?(?:how|why|what|where|which|when|who)(?: (?!you\b|we\b|this\b|the\b)\w+)? (?:do|does|did|is|are|was|were|can|could|should|would|will|has|have|to)\b",
            r"^(?:(?:does|has|did|can|could|is there) )?(?:any(?:one|body)\b(?: else| here)? (?:knows?|has|have|had|sees?|seen|gets?|got|tried|explain)|some(?:one|body)\b(?: else| here)? (?:knows?|explain))\b",
            # what somebody or something says
            rf"\b(?:it|he|she|they|browser|reader|client|editor|app|tool|console|log|screen|proxy|server|visitors?|users?|people|everyone|colleagues?) (?:just |only |now |always |then |still )?{_SAYS}\b",
            # a quotation (masked) that something says or that is called a text; 'the page ⟦⟧ could not be found' is a notice
            rf"\b(?:{_SAYS}|messages?|texts?|notices?|banners?|sentences?|lines?|words?|labels?|called|like)\b\W*⟦⟧|⟦⟧ means\b",
            # a bare field name that something puts into a text
            rf"^\w+(?: \w+){{0,4}} {_PUTS} (?:the |a |an |me |us |only )?[\[<][\w ]+[\]>](?! *[.!,]? *$)",
        )
    ),
    re.I,
)
CODE_RE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|`[^`\n]+`", re.S | re.I)
QUOTE_RE = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”")
URL_RE = re.compile(r"\b(?:https?|ftp)://\S+")
WORD_RE = re.compile(r"[^\W\d_]+|\d+")
_ID_RE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b", re.I)
_SPLIT_RE = re.compile(r"(?<=[.!?;])\s+")
_DIGIT_RE = re.compile(r"\d+")
_WORDS_ONLY_RE = re.compile(r"[^\W\d_]+(?:[ .,!?]+[^\W\d_]+)*[ .,!?]*")

ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEIGHBOURS = {a + b for row in ROWS for i, a in enumerate(row) for b in row[max(i - 1, 0) : i + 2]}
#: Above this weight template syntax alone makes residue; the others need more evidence.
TEMPLATE, STRONG, WEAK = 2.0, 1.5, 1.25
#: Kind of a unit that a site or form could say, without anything that says so: no evidence, and no content either.
MANNER = "manner"
#: Share of a unit's content words that must be of one vocabulary; beyond FULL_SHARE one core word is enough.
FULL_SHARE, STRONG_SHARE, WEAK_SHARE = 0.8, 0.7, 0.55


class Vocabulary:
    """Words and stems with a weight."""

    def __init__(self, core: str, manners: str = "", manner_weight: float = 0.8) -> None:
        self.words: dict[str, float] = {}
        stems: dict[str, float] = {}
        for text, weight in ((manners, manner_weight), (core, 1.0)):
            for w in text.split():
                (stems if w.endswith("*") else self.words)[w.rstrip("*")] = weight
        self.stems = sorted(stems.items(), key=lambda kv: -len(kv[0]))

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        return found if found is not None else next((w for s, w in self.stems if word.startswith(s)), 0.0)


_EMPTY = frozenset(FUNCTION_WORDS.split())
_SITE = Vocabulary(f"{THINGS} {STATES}", f"{ABLE} {MANNERS}")
_VOCABULARIES = (_SITE, Vocabulary(DRAFT, DRAFT_MANNERS), Vocabulary(LATIN), Vocabulary(STATES), Vocabulary(ABLE))


class Judge:
    """Judges units, remembering words and units seen (a bounded memory: it is emptied when full)."""

    def __init__(self, pairs: np.ndarray | None, memory: int = 100_000) -> None:
        self.pairs, self.memory = pairs, memory
        self.words: dict[str, tuple] = {}
        self.units: dict[str, tuple] = {}

    def word(self, w: str) -> tuple[bool, tuple[float, ...], int]:
        """(carries content, weight in each vocabulary or () if in none, term): the term is a hash, 0 for short or empty words."""
        found = self.words.get(w)
        if found is None:
            if len(self.words) > self.memory:
                self.words.clear()
            if w.isdigit():
                status = len(w) == 3 and w[0] in "45"
                found = (status, (1.0, 0.0, 0.0, 1.0, 0.0) if status else (), 0)
            else:
                full = w not in _EMPTY and len(w) > 1
                weights = tuple(v.weight(w) for v in _VOCABULARIES) if full else ()
                term = zlib.crc32(w.encode("utf-8", "replace")) - 2**31 if full and len(w) > 3 else 0
                found = (full, weights if any(weights) else (), term)
            self.words[w] = found
        return found

    def unit(self, text: str) -> tuple[str, float, frozenset[int], int]:
        """(kind, weight, terms, fingerprint) of a unit; kind is empty for ordinary content, and weight 0 but for residue."""
        found = self.units.get(text)
        if found is None:
            if len(self.units) > self.memory:
                self.units.clear()
            found = self.units[text] = self._unit(text)
        return found

    def _unit(self, text: str) -> tuple[str, float, frozenset[int], int]:
        plain = text.lower()
        marked = MARKS_RE.search(text) is not None
        if "<" in plain or "-->" in plain:
            plain = _TAG_RE.sub(" ", plain)
        if "/" in plain:
            plain = _PATH_RE.sub(" ", URL_RE.sub(" ", plain))
        if _DIGIT_RE.search(plain):
            plain = _ID_RE.sub(" ", plain)
        tokens = WORD_RE.findall(plain)
        seen = [self.word(w) for w in tokens]
        kind, weight = self._kind(text, tokens, seen, marked)
        print_ = zlib.crc32(_DIGIT_RE.sub("#", _ID_RE.sub("#", TEMPLATE_RE.sub("□", text).lower())).encode("utf-8", "replace")) - 2**31 if weight else 0
        return kind, weight, frozenset([s[2] for s in seen if s[2]]), print_

    def _kind(self, text: str, tokens: list[str], seen: list[tuple], marked: bool) -> tuple[str, float]:
        if marked and TEMPLATE_RE.search(text):
            return "template", TEMPLATE
        n = site = draft = latin = states = able = 0
        core = [0.0, 0.0, 0.0]
        for full, w, _ in seen:
            if full:
                n += 1
                if w:
                    site, draft, latin, states, able = site + w[0], draft + w[1], latin + w[2], states + w[3], able + w[4]
                    for k in range(3):
                        core[k] += w[k] == 1.0
        lowered = text.lower()
        if not n and _BLANK_RE.fullmatch(text):
            return MANNER, 0.0
        if site:
            if STATE_RE.search(lowered):
                states, core[0], site = states + 1, core[0] + 1, min(float(n), site + 0.2)
            if able and NEGATION_RE.search(lowered):
                states, core[0], site = states + able, core[0] + able, site + 0.2 * able
        share = [x / n if n else 0.0 for x in (site, draft, latin)]
        service = states > 0 and share[0] >= WEAK_SHARE
        drafted = core[1] > 0 and share[1] >= WEAK_SHARE
        latin_ = core[2] > 0 and share[2] >= WEAK_SHARE
        prompt = share[1] >= WEAK_SHARE and APART_RE.search(text) is not None
        bar = share[0] >= STRONG_SHARE and NAVIGATION_RE.search(lowered) is not None
        void = not _VOIDS.isdisjoint(tokens) and LEAK_RE.search(lowered) is not None
        machine = (not _MACHINE_WORDS.isdisjoint(tokens) or "_" in text or " /" in text or "xception" in text) and MACHINE_RE.search(lowered) is not None
        bracketed = marked and BRACKETED_RE.search(text) is not None
        noise = self._noise(tokens, n, site + draft > 0, lowered) if len(tokens) > 2 else ""
        if not (service or drafted or latin_ or prompt or bar or void or machine or bracketed or noise):
            return (MANNER if n and max(share[:2]) >= STRONG_SHARE else ""), 0.0
        tagged = marked and TAGGED_RE.search(text) is not None
        if not tagged and TALK_RE.search(text):
            return "", 0.0
        if void:
            return "leak", STRONG
        if noise:
            return noise, STRONG
        if latin_:
            return "latin", STRONG if n > 2 and share[2] >= STRONG_SHARE else WEAK
        if prompt or drafted and n > 1 and (share[1] > FULL_SHARE - 1e-9 or core[1] > 1 and share[1] >= STRONG_SHARE):
            return "draft", STRONG
        if service and (n > 1 or states > 1) and (share[0] > FULL_SHARE - 1e-9 or core[0] > 1 and share[0] >= STRONG_SHARE):
            return "service", STRONG
        if bar:
            return "navigation", STRONG
        if machine:
            return "machine", STRONG if service or tagged else WEAK
        if bracketed:
            return "bracketed", STRONG if n - 1 <= 2 or SALUTATION_RE.search(lowered) else WEAK
        return ("service" if service else "draft"), WEAK

    def _noise(self, words: list[str], n: int, known: bool, lowered: str) -> str:
        """Repeated words; and keyboard rows or letters unlike the corpus, in units without function words."""
        k = len(words)
        different = len(set(words))
        if different * 3 > k and n < k:  # ordinary words, function words among them
            return ""
        words = [w for w in words if not w.isdigit()]
        k = len(words)
        if k < 3:
            return ""
        if len(set(words)) * 3 <= k:
            return "repetition"
        if n < k or not all(w not in _EMPTY and len(w) > 1 for w in words):
            return ""
        steps = [w[i : i + 2] for w in words for i in range(len(w) - 1)]
        if steps and sum(s in _NEIGHBOURS for s in steps) >= 0.75 * len(steps):
            return "keyboard"
        if self.pairs is not None and k > 3 and not known and _WORDS_ONLY_RE.fullmatch(lowered) and unlikely(words, self.pairs):
            return "gibberish"
        return ""


LETTERS = 28  # a..z, any other letter, anything else
_TABLE = np.full(65536, 26, np.uint8)
_TABLE[:128] = 27
_TABLE[ord("a") : ord("z") + 1] = np.arange(26)
_TABLE[128:192] = 27


def letter_pairs(texts: list[str], most: float = float("inf")) -> np.ndarray:
    """Weighted counts of adjacent symbols (LETTERS x LETTERS, flat) of lower-cased texts; a text of more than ``most`` pairs weighs ``most``."""
    codes = [np.frombuffer(t.lower().encode("utf-16-le", "replace"), np.uint16) for t in texts]
    lengths = np.array([len(c) for c in codes])
    if not lengths.sum():
        return np.zeros(LETTERS * LETTERS)
    s = _TABLE[np.concatenate(codes)].astype(np.int32)
    pair = s[:-1] * LETTERS + s[1:]
    weight = np.repeat(np.minimum(1.0, most / np.maximum(lengths - 1, 1)), lengths)
    ends = np.cumsum(lengths)
    weight[ends[lengths > 0] - 1] = 0.0  # no pair over the edge of two texts
    return np.bincount(pair, weight[:-1], LETTERS * LETTERS)


def unlikely(words: list[str], pairs: np.ndarray) -> bool:
    """Are the letters further from the corpus's pairs than letters drawn at random from its single letters would be on half the way?

    ``pairs``: (log-probability of the next symbol, of a symbol by itself), LETTERS x LETTERS each.
    """
    n = letter_pairs([" ".join(words)]).reshape(LETTERS, LETTERS)
    total = n.sum()
    return total > 15 and float((n * (pairs[0] - pairs[1])).sum()) < 0.0


def without_code(text: str) -> str:
    return CODE_RE.sub(" ", text) if "`" in text or "~~~" in text or "<" in text else text


def split_units(text: str) -> list[str]:
    """Lines' sentences outside code, quotations and quoted lines; machine output and mark-up lines stay whole."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = without_code(text)
    units = []
    for line in text.split("\n"):
        line = line.strip()
        if not line or line[0] == ">":
            continue
        if line[0] == "{" and line[-1] == "}" or line[0] == "<" and TAGGED_RE.search(line):
            units.append(line)
            continue
        if '"' in line or "“" in line:
            line = QUOTE_RE.sub(" ⟦⟧ ", line).strip()
        units += [u for u in _SPLIT_RE.split(line) if u]
    return units
