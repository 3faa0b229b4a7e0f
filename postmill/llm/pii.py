"""Problem 7: personal information in free text.

Regular expressions propose spans, checksum validators confirm or refute numbers, and nearby context words move the
score of every kind of span; what scores enough is replaced by a typed placeholder. Card and account numbers count only
if their checksum holds. Of other identity numbers a wrong check digit lowers the score, but one that the text calls so
still counts: people mistype them, and specimens are made to fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import ship_package

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON_NAME")
#: A span counts from this score on.
ACCEPT = 2
#: Letters looked at before and after a span for context words.
BEFORE, AFTER = 34, 30

#: Common given names (fixed values).
GIVEN_NAMES = frozenset(
    """
    adam aisha alejandro alice amara amina amit ana andrea anita anna anselm antonio anya arjun asha astrid ben bruno
    camille carla carlos carmen chiara chloe cillian clara claudia daniel david deepak devika diego dmitri elena eleni
    elif emeka emil emily emma eric esther eva farah fatima felix fernando fiona florian francesca gabriel george
    giulia greta hannah hans hassan helen helena henrik hiroshi hugo ibrahim ines inés ingrid irene isabel isha
    ishaan ivan jack james jan jana javier jean joana johan john jonas jorge jorun josé joão juan julia julien kamal
    karin kavita kavya kenji klara kofi lara laura lea leena leila lena leon lina lisa lucas lucia lucía luis lukas
    magda maria marie marta martin mateo matteo max maya mei michael miguel mila milo mina mira mohammed nadia naomi
    natalia neha nikhil nina noah nora olga oliver olivia omar oskar otto pablo paul pedro peter petra pierre priya
    rahul rania rohit rosa ruth samuel sanjay sara sarah simon sofia solene solène sophie stefan sunita tamsin tariq
    thomas tobin tomas ulrich vera victor vikram wanda yuki yusra zara zoe zuzana
    """.split()
)
#: Words directly before a person's name, sure and likely ones (fixed values).
_TITLE = re.compile(r"(?:^|[^\w])(?:dr|prof|mr|mrs|ms|herr|herrn|frau|señora?|sr|sra|don|doña|mme|mlle|monsieur|madame|shri|smt|dona|senhora?)\.? $", re.I)
_NAMED = re.compile(
    r"(?:^|[^\w])(?:name is|named|called|i am|i['’]m|regards,?|signed,?|sincerely,?|thanks to|thank you,?|desk with|meet|met|interviewed|ask|dear|"
    r"heiße|heißt|namens|dank an|me llamo|se llama|llamada|gracias a|je m['’]appelle|s['’]appelle|merci à|grâce à|me chamo|chama-se|obrigad[oa] a|naam|enseñó|ensinou|appris)\s+$",
    re.I,
)
_LIKELY_NAMED = re.compile(r"(?:^|[^\w])(?:by|with|as|from|and|for|mir|von|mit|por|con|como|par|avec|mujhe|com|aur)\s+$", re.I)
#: Words directly after one.
_PERSON_AFTER = re.compile(
    r"(?: |, )(?:asked|joined|replied|explained|taught|put it|sent|beigebracht|enseñó|m['’]a|ensinou|ne|ko|ka|ki)(?!\w)",
    re.I,
)
#: Words of speaking, which only persons do.
_SPEAKS = re.compile(r"(?: |, )(?:said|says|spoke|speaks|wrote|writes|told|smiled|laughed|thinks|thought|sagte|sagt|schrieb|dijo|dice|escribió|a dit|disse|bola|boli)(?!\w)", re.I)
#: Words that no family name is: of organisations, places and the calendar, and those that begin sentences (fixed values).
_ORGANISATIONS = frozenset(
    """
    labs lab works studio studios inc llc ltd gmbh ag kg sa sas corp co company group holding holdings mobility systems foods health partners networks network collective
    university college school institute academy bank capital ventures media press news hotel hospital clinic museum church foundation trust society association club team
    agency consulting solutions software technologies technology tech digital energy motors airlines records pictures services service conference summit festival award tools
    """.split()
)
_NO_NAMES = _ORGANISATIONS | frozenset(
    """
    street road avenue lane drive square station park lake river bay city county valley mountain island beach bridge airport tower hall house centre center
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag
    the a an and or but if so as at by in on of to for from with this that these those we our you your he she they it its i my me what who when where why how not no yes
    is are was were be been has have had do does did can will would should one two all some more most here there then now today please thanks thank dear hello hi hey
    said says sent put taught wrote told asked
    der die das ein eine und oder ist sind wir ich sie er es nicht von zu mit für auf im am hat haben wie was wer heute danke liebe lieber hallo
    el la los las un una y o de en que no es por para con se su mi nos lo hoy gracias hola le les des du et ou est dans pour avec sur au aux il elle on nous vous merci bonjour
    os um uma e do da dos das na com não obrigado hoje olá hai ka ki ke ko se aur ne yeh woh dosto
    """.split()
)
_COMMA = ", "
_INITIALS = re.compile(r"(?: [^\W\d_]\.)* ")
_LETTERS = r"[^\W\d_]"
_WORD = re.compile(_LETTERS + r"+")
_NAME = re.compile(_LETTERS + r"+(?:-" + _LETTERS + r"+)?")
_CAPITAL = re.compile(r"(?<![^\W_])[^\W\d_a-z]" + _LETTERS + r"+(?:-" + _LETTERS + r"+)?")
_MAIL = re.compile(
    r"(?:mailto:)?\b[\w][\w.+-]*(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)[a-z0-9][a-z0-9-]*(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)[a-z0-9-]+)+"
    r"|\b[\w][\w.+-]*\s+at\s+[a-z0-9][a-z0-9-]*(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)[a-z0-9-]+)+",
    re.I,
)
_DIGITS = re.compile(r"(?<![\w.,#/@-])(?:\+|\(\+?)?\d(?:\d|[ .\-/()]{1,2}(?=[\d(]))*\d(?![\w%@])(?!,\d)")
_DATE = re.compile(r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})$")
_PHONE_SHAPE = re.compile(
    r"^(?:\(\d{2,5}\) ?\d{3}[ .-]?\d{3,4}|\d{3}([ .-])\d{3}\1\d{3,4}|\d{3}[.-]\d{4}|0\d{2,5}[ /-]\d{3,4} ?-?\d{3,6}|0\d{4,5}-\d{5,6}|0\d{2,4}/\d{5,8}|"
    r"0\d(?:[ .]\d{2}){4}|\d{5} \d{5}|0\d{9,10})$"
)
_PHONE_BEFORE = re.compile(
    r"\b(?:call|phone|ph|tel|telefon|telephone|teléfono|telefone|téléphone|mobile|mob|cell|fax|text|sms|whatsapp|reach|dial|ring|mujhe|"
    r"ruft|anrufen|erreich\w*|unter|ll[aá]ma\w*|llamen|escr[ií]be\w*|appele\w*|joindre|ligue\w*|n[uú]mero|numéro|nummer|number)\b",
    re.I,
)
_PHONE_AFTER = re.compile(r"\b(?:call|calls|message|text|sms|whatsapp|evenings?|mornings?|office hours|after (?:six|\d)|anrufen|abends|morgens|tagsüber|tardes?|mañanas?|noche|soir|matin|noite|and i will)\b", re.I)
_NOT_PHONE = re.compile(r"\b(?:order|ticket|invoice|version|req|ref|isbn|tracking|pedido|bestellung|commande|aadhaa?r|ssn|security|passport|insurance)\b\W*(?:\w+\W+)?$|[€$£]\s?$", re.I)

_ID_CUE = re.compile(
    r"\b(?:ni num(?:ber)?|ni no|national insurance|passport|pasaporte|passaporte|passeport|reisepass\w*|ssn|social security|seguridad social|"
    r"sécurité sociale|segurança social|sozialversicherung\w*|aadhaa?r|pan|dni|nie|nif|cpf|national id|id (?:card|number)|identity (?:card|number)|"
    r"(?:personal)?ausweis\w*|steuer-?(?:id|nummer)\w*|tax (?:id|number|no)|tin|driv\w+['’]?s? licen[cs]e|driving licen[cs]e|führerschein\w*|permis|"
    r"permiso de conducir|licencia de conducir|voter id)\b",
    re.I,
)
_ID_LINK = re.compile(r"(?:[\s:.#°º]|\b(?:number|no|nr|num|num[eé]ro|número|nummer|is|ist|lautet|es|est|é|hai|de|of|my|mein|mi)\b)*", re.I)
_ID_TOKEN = re.compile(r"[A-Za-z]{5}\d{4}[A-Za-z]\b|(?:[A-Za-z]{1,3}[ -]?)?\d(?:[ -]?[A-Za-z]?[ -]?\d)*(?:[ -]?[A-Za-z]\b)?")
_ID_SHAPE = re.compile(
    r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{5}\d{4}[A-Z]|\d{8}-?[A-Z]|[A-Z]\d{7,8}|\d{4}([ -])\d{4}\1\d{4}|"
    r"\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{2}-\d{3}-\d{5})(?![\w-])(?![ -]\d)"
)
#: Account numbers, and runs of 13 to 19 digits with blanks or hyphens between them: cards. Their checksums decide, whatever stands around them.
_ACCOUNT = re.compile(r"(?<![\w-])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])")
_CARD = re.compile(r"(?<![\w.,+/-])(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)(?![\w%])")
_NOT_ID = re.compile(r"\b(?:order|ticket|ref|req|invoice|isbn|tracking|pedido|bestellung|commande)\b\W*(?:\w+\W+)?$", re.I)

_NAME_WORD = r"[^\W\d_a-z][^\W\d_]*(?:-[^\W\d_]+)?"
_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|boulevard|blvd|court|terrace|square|close|crescent|marg|nagar|gali|chowk|colony|vihar)"
_TAIL = r"(?:,? (?i:apt|apartment|unit|suite)\.? \d+\w?)?(?:,? (?:\d{1,2}º ?\w?\b))?(?:,? ?(?:\d{4,6} )?%s)?(?:(?:,| -)? \d{4,6})?" % _NAME_WORD
_ADDRESSES = [
    re.compile(r"(?:\b(?i:flat|apt|apartment|house|plot)\.? \d+\w?, ?)?\b\d{1,5}(?:/\d+)?[A-Z]?,? %s(?: %s){0,2} (?i:%s)\b\.?%s" % (_NAME_WORD, _NAME_WORD, _STREET, _TAIL)),
    re.compile(r"\b(?i:flat|apt|apartment|house|plot)\.? \d+\w?, ?%s(?: %s){0,2} (?i:%s)\b%s" % (_NAME_WORD, _NAME_WORD, _STREET, _TAIL)),
    re.compile(r"\b(?i:p\. ?o\. ?box|po box|postfach|apartado(?: de correos| postal)?|boîte postale|caixa postal) \d+%s" % _TAIL),
    re.compile(r"\b[^\W\d_a-z][^\W\d_]+(?i:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm) \d{1,4} ?[a-z]?\b%s" % _TAIL),
    re.compile(
        r"\b(?i:calle|c/|plaza|avenida|avda\.?|av\.|paseo|rua|travessa|praça|rue|boulevard|place|allée|chemin|via) "
        r"(?i:(?:de|del|la|las|los|da|do|dos|des|du) )*%s(?: %s)?,? (?:n[ºo°.] ?)?\d{1,4}\b%s" % (_NAME_WORD, _NAME_WORD, _TAIL)
    ),
    re.compile(r"\b(?i:house|plot|flat|shop) (?i:no)\.? ?\d+\w?,? (?i:sector|block|phase|ward) \w+(?:, %s)?" % _NAME_WORD),
    re.compile(r"\b(?:(?i:am|im|zum|zur|an der|an den|auf der|auf dem|in der|unter den)) %s \d{1,4} ?[a-z]?, \d{5} %s" % (_NAME_WORD, _NAME_WORD)),
    re.compile(r"\b\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai) (?:(?:de|la|des|du) )*%s%s" % (_NAME_WORD, _TAIL)),
]
#: Words and endings, one of which each of the patterns above needs, in their order.
_STREET_WORDS = frozenset("street st road rd avenue ave lane ln drive boulevard blvd court terrace square close crescent marg nagar gali chowk colony vihar".split())
_ADDRESS_NEEDS = (
    _STREET_WORDS, _STREET_WORDS, frozenset("box postfach apartado postale postal".split()), frozenset(),
    frozenset("calle c plaza avenida avda av paseo rua travessa praça rue boulevard place allée chemin via".split()), frozenset("house plot flat shop".split()),
    frozenset("am im zum zur der den dem".split()), frozenset("rue avenue boulevard place allée chemin impasse quai".split()),
)
_ADDRESS_ENDINGS = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ufer", "damm")
_BRACKETED_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
#: Words and beginnings of words without which no identity number is named.
_ID_WORDS = frozenset(
    "ni national passport pasaporte passaporte passeport ssn social seguridad sécurité segurança aadhar aadhaar pan dni nie nif cpf id identity tax tin permis permiso licencia voter".split()
)
_ID_BEGINNINGS = ("reisepass", "sozialversicherung", "personalausweis", "ausweis", "steuer", "driv", "führerschein")
#: Digits without which a text holds no card, no number of a known shape, no identity number, and no phone number.
_CARD_DIGITS, _SHAPE_DIGITS, _ID_DIGITS, _PHONE_DIGITS = 13, 4, 4, 7
_DIGIT = re.compile(r"\d")
#: What a word may begin or be a part of, in bits: a spelt-out mail address, an identity number, and from _PLACE on each pattern of addresses.
_DOT, _AT, _NAMES_ID, _PLACE = 1, 2, 4, 8
_traits: dict[str, int] = {}


def _traits_of(word: str) -> int:
    low = word.lower()
    if len(_traits) > 300_000:
        _traits.clear()
    found = _DOT * (low == "dot") | _AT * (low == "at") | _NAMES_ID * (low in _ID_WORDS or low.startswith(_ID_BEGINNINGS))
    for k, needs in enumerate(_ADDRESS_NEEDS):
        found |= (_PLACE << k) * (low in needs or not needs and low.endswith(_ADDRESS_ENDINGS))
    _traits[word] = found
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _turned(a: int, b: int) -> int:
    """Product in the group of the turns (0 to 4) and flips (5 to 9) of a pentagon."""
    return (a + b - 5) % 5 + 5 if a < 5 <= b else (a + b) % 5 if b < 5 and a < 5 else (a - b) % 5 + 5 * (b < 5)


def verhoeff(digits: str) -> bool:
    """The check of identity numbers of twelve digits: each digit, permuted once for each place before it, is a turn or a flip, and all together leave things as they are."""
    total = 0
    for place, ch in enumerate(reversed(digits)):
        d = int(ch)
        for _ in range(place % 8):
            d = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[d]
        total = _turned(total, d)
    return total == 0


def dni(number: str) -> bool:
    """The letter of a Spanish number is its remainder by 23; foreigners' numbers begin with a letter that stands for a digit."""
    plain = re.sub(r"[ -]", "", number).upper()
    value = int("XYZ".find(plain[0]) if plain[0] in "XYZ" else plain[0]) * 10**7 + int(plain[1:-1])
    return "TRWAGMYFPDXBNJZSQVHLCKE"[value % 23] == plain[-1]


def cpf(digits: str) -> bool:
    """Two check digits, each ten times a weighted sum by 11."""
    return all(sum(int(d) * (n + 1 - k) for k, d in enumerate(digits[:n])) * 10 % 11 % 10 == int(digits[n]) for n in (9, 10))


def checked(raw: str) -> bool | None:
    """Whether an identity number's check digit holds; None for shapes that have none."""
    plain = re.sub(r"[ .-]", "", raw)
    if re.fullmatch(r"[XYZxyz]?\d{7,8}[A-Za-z]", plain) and len(plain) == 9:
        return dni(plain)
    if re.fullmatch(r"\d{12}", plain):
        return plain[0] not in "01" and verhoeff(plain)
    if re.fullmatch(r"\d{11}", plain) and "." in raw:
        return cpf(plain)
    return None


def _title(text: str) -> str:
    """A text without capitals gets them on every word, one without small letters loses them after the first; lengths stay."""
    if text == text.lower() or text == text.upper():
        changed = _WORD.sub(lambda m: m[0][0].upper() + m[0][1:].lower(), text)
        return changed if len(changed) == len(text) else text
    return text


def _phone_score(text: str, start: int, end: int) -> int:
    raw = text[start:end]
    number = sum(c.isdigit() for c in raw)
    if not 7 <= number <= 15 or _DATE.match(raw):
        return 0
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    score = 2 * (raw.startswith(("+", "(+")) and number >= 9) + (raw.startswith("00") and number >= 11) + bool(_PHONE_SHAPE.match(raw))
    score += 2 * bool(_PHONE_BEFORE.search(before)) + bool(_PHONE_AFTER.search(after))
    score += bool(re.match(r"^0\d", raw)) and any(c in " /-" for c in raw)
    return score - 3 * bool(_NOT_PHONE.search(before))


def _number_spans(text: str, digits: int, named: bool) -> Iterator[tuple[int, int, str, int]]:
    """Identity, account and card numbers. A span of score 0 is none, and keeps others from taking a part of it.

    digits: how many digits the text has at most; named: whether a word of it may name an identity number.
    """
    for pattern, valid in ((_ACCOUNT, mod97), *([(_CARD, luhn)] if digits >= _CARD_DIGITS else [])):
        for m in pattern.finditer(text):
            before = text[max(0, m.start() - BEFORE) : m.start()]
            if not _ID_CUE.search(before) and not _PHONE_BEFORE.search(before):
                yield m.start(), m.end(), "ID_NUMBER", 6 * (valid(m[0] if pattern is _ACCOUNT else re.sub(r"\D", "", m[0])) and not _NOT_ID.search(before))
    for cue in _ID_CUE.finditer(text) if named else ():
        link = _ID_LINK.match(text, cue.end())
        token = _ID_TOKEN.match(text, link.end() if link else cue.end())
        if token and (sum(c.isdigit() for c in token[0]) >= 5 or len(token[0]) == 10):
            yield token.start(), token.end(), "ID_NUMBER", 4 + _CHECKED[checked(token[0])]
    for m in _ID_SHAPE.finditer(text) if digits >= _SHAPE_DIGITS else ():
        before = text[max(0, m.start() - BEFORE) : m.start()]
        yield m.start(), m.end(), "ID_NUMBER", 3 + _CHECKED[checked(m[0])] - 3 * bool(_NOT_ID.search(before))


#: What a check digit adds to the score: it holds, doesn't hold, or there is none.
_CHECKED = {True: 1, False: -2, None: 0}
_MAIL_BEFORE = re.compile(r"\b(?:e-?mails?|mail|write|contact|inbox|reach|questions|send|address|schreib\w*|kontakt|escr[ií]b\w*|correo|écri\w*|contacte\w*|courriel|escreva\w*|bhejo|karo)\b", re.I)
_MAIL_DOMAIN = re.compile(r"(?:\.|dot\W*)[a-z][a-z0-9-]*$", re.I)
_PLACE_BEFORE = re.compile(
    r"\b(?:moved to|live|lives|living|drop by|visit|send|ship|post|address|meet|office|find us|located|based|wohn\w*|adresse|umgezogen|besuch\w*|an|mudamos|direcci[oó]n|vivo|envíen|muestras|"
    r"habite|adresse|envoyez|endereço|moro|enviem|pata|samaan|rehta|rehte)\b",
    re.I,
)
_POSTCODE = re.compile(r"\b\d{4,6}\b(?!.*\b\d{4,6}\b)")


def _mail_score(text: str, start: int, end: int) -> int:
    """An address counts by its shape; a domain that doesn't end in letters, or a path after it, speaks against it."""
    score = 3 + bool(_MAIL_BEFORE.search(text[max(0, start - BEFORE) : start])) + text[start:end].lower().startswith("mailto:")
    return score - 3 * (not _MAIL_DOMAIN.search(text[start:end])) - 3 * (text[end : end + 1] in "/:" and text[end + 1 : end + 2].isalnum())


def _address_score(text: str, start: int, end: int) -> int:
    score = 2 + bool(_PLACE_BEFORE.search(text[max(0, start - BEFORE) : start])) + bool(_POSTCODE.search(text[start:end]))
    return score - 2 * bool(re.match(r" ?(?:km|miles|kg|percent|%|€|\$)", text[end : end + 9]))


def _name_spans(text: str, plain: str) -> Iterator[tuple[int, int, str, int]]:
    """Pairs of capitalised words, with initials between them, or with a comma and the family name first.

    plain is the text as it stands: where it is all in one case, capitals tell nothing, so the given name must be a known
    one and more around it must speak for a person.
    """
    least = ACCEPT + (text != plain)
    words = [m for m in _CAPITAL.finditer(text) if m[0][0].isupper()]
    for lead, one, two in zip([None, *words], words, words[1:], strict=False):
        gap = text[one.end() : two.start()]
        if gap == _COMMA:
            family, given = one[0], two[0]
            score = 2 * (given.lower() in GIVEN_NAMES) - 1 + (plain[one.start() : one.end()].isupper() and not plain[two.start() : two.end()].isupper())
        elif gap == " " or _INITIALS.fullmatch(gap):
            given, family = one[0], two[0]
            score = 2 * (given.lower() in GIVEN_NAMES)
            if not score and lead and text[lead.end() : one.start()] == " " and lead[0].lower() not in _NO_NAMES and not _TITLE.search(text[: one.start()][-BEFORE:]):
                score = -1  # the end of a longer name, as of a paper or a place
        else:
            continue
        if len(family) < 3 or family.lower() in _NO_NAMES or score < 2 and given.lower() in _NO_NAMES:
            continue
        if given.lower() not in GIVEN_NAMES and (text != plain or plain[one.start() : two.end()].isupper()):
            continue
        if text[one.start() - 1 : one.start()] in tuple("@._+-#/&") or text[two.end() : two.end() + 1] in tuple("@_") or text[two.end() : two.end() + 2] == " &":
            continue
        before, after = text[max(0, one.start() - BEFORE) : one.start()], text[two.end() : two.end() + AFTER]
        score += 2 * bool(_TITLE.search(before) or _NAMED.search(before)) + bool(_LIKELY_NAMED.search(before)) + bool(_PERSON_AFTER.match(after)) + 2 * bool(_SPEAKS.match(after))
        if (following := _NAME.match(text, two.end() + 1)) and text[two.end()] == " " and following[0].lower() in _ORGANISATIONS:
            score -= 4
        if score >= least:
            yield one.start(), two.end(), "PERSON_NAME", min(score, 4)


def find_spans(text: str | None, gated: bool = True) -> list[tuple[int, int, str, int]]:
    """``(start, end, kind, score)`` of the personal data of a text, in order and without overlap.

    Where proposals overlap, the higher score counts, then the longer span, then the earlier start; what scores less than
    ACCEPT is dropped, and a number that a checksum refutes keeps others from taking a part of it. Null and empty texts
    have none. Without ``gated`` every pattern is tried on every text, with the same result.
    """
    if not text:
        return []
    plain = text.replace("\xa0", " ")
    cased = _title(plain)
    traits = 0
    for word in set(_WORD.findall(cased)):
        traits |= known if (known := _traits.get(word)) is not None else _traits_of(word)
    digits = len(_DIGIT.findall(plain))
    if not gated:
        traits, digits = -1, 99
    spans: list[tuple[int, int, str, int]] = []
    if not gated or "@" in plain or traits & _DOT or traits & _AT and _BRACKETED_AT.search(plain):
        spans += [(m.start(), m.end(), "EMAIL", 1 + _mail_score(plain, m.start(), m.end())) for m in _MAIL.finditer(plain)]
    refuted: list[tuple[int, int]] = []
    if digits >= _ID_DIGITS:
        numbers = list(_number_spans(plain, digits, bool(traits & _NAMES_ID)))
        spans += numbers
        refuted = [(a, b) for a, b, _, score in numbers if score == 0]
    if digits >= _PHONE_DIGITS:
        for m in _DIGITS.finditer(plain):
            if m.end() - m.start() >= 7:
                spans.append((m.start(), m.end(), "PHONE", _phone_score(plain, m.start(), m.end())))
    if digits and traits >= _PLACE or not gated:
        for k, pattern in enumerate(_ADDRESSES):
            if traits & (_PLACE << k):
                spans += [(m.start(), m.end(), "ADDRESS", 1 + _address_score(cased, m.start(), m.end())) for m in pattern.finditer(cased)]
    spans += _name_spans(cased, plain)
    kept: list[tuple[int, int, str, int]] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        if s[3] < ACCEPT or s[2] in ("PHONE", "ID_NUMBER") and any(s[0] < b and s[1] > a for a, b in refuted) and s[3] < 4:
            continue
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def masked(text: str | None, spans: list[tuple[int, int, str, int]]) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


_SPANS = "spans array<struct<start:int,stop:int,kind:string,score:int>>"


def mask_table(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id, text, spans``: every row's text with ``[KIND]`` for each piece of personal data, and where it stood.

    Positions count code points of the original text. A null text stays null, an empty one empty, both without
    spans. Other columns of ``df`` are ignored.
    """
    ship_package(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            found = [find_spans(t) for t in texts]
            yield pd.DataFrame(
                {
                    "id": frame["id"],
                    "text": [masked(t, s) for t, s in zip(texts, found, strict=True)],
                    "spans": [[{"start": a, "stop": b, "kind": k, "score": int(c)} for a, b, k, c in s] for s in found],
                }
            )

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id bigint, text string, {_SPANS}")


def kinds_found(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id, kind``, one row for each kind of personal data in a row's text."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<string>")
    def kinds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({s[2] for s in find_spans(t)}) if isinstance(t, str) else [])

    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.explode(kinds(F.col(text_col))).alias("kind"))
