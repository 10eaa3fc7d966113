"""Sentences made by a grammar, with personal data and look-alikes in them, to fit problem 2 on.

No sentence is written out and none comes from a corpus: words of a few roles, fields,
lists, code and signatures are put together at random around an item, so that what is
left to learn is the item's own format and the cue words near it. Cue words stand near an
item often but not always, and near look-alikes too.
"""

from __future__ import annotations

import random

# Plain words by role, and what may introduce an item of each type.
NOUNS = "garden window letter bridge ticket lamp market river engine camera bottle village kitchen form folder screen meeting train parcel invoice report shelf cable battery budget concert season harbour printer orchard lesson station carpet theatre museum basket blanket cellar drawer pencil ladder bakery queue index worker cache buffer schema token plugin".split()
VERBS = "opened closed moved painted carried counted checked fixed broke sent lost found kept sold built cleaned dropped painted renamed copied loaded parsed signed printed stored mailed answered ordered repaired measured returned".split()
ADJECTIVES = "green small late quiet heavy narrow broken early plain modern cold silver wooden local public empty third final noisy simple".split()
SMALL = "the a this that our their every some one no my his her your each another".split()
LINKS = "in on at for with from by to of and but near under after before about over into since until because when while".split()
TIMES = "yesterday today tomorrow again now later soon twice often tonight".split()
ABROAD = {
    "de": ("der die das ein eine und oder mit für auf nach bei seit wenn weil nicht noch auch".split(), "Fenster Brücke Garten Anhang Rechnung Bericht Verhalten Fehler Dienst Vorlage".split()),
    "es": ("el la los un una y con para por desde cuando porque no también".split(), "ventana puente jardín factura informe error servicio".split()),
    "fr": ("le la les un une et avec pour par depuis quand car pas aussi".split(), "fenêtre pont jardin facture rapport erreur service".split()),
    "pt": ("o a os um uma e com para por desde quando porque não também".split(), "janela ponte jardim fatura relatório erro serviço".split()),
}
PLACES = "Bay Falls Hill Green Cross Heath Bridge".split()
CUES = {
    0: "email e-mail mail contact owner user write ask notify account login sender recipient reply-to".split(),
    1: "phone tel telephone mobile cell call fax sms text whatsapp dial ring number hotline telefon teléfono téléphone desk reach".split(),
    2: ["ssn", "social security", "passport", "passport no.", "tax id", "tax number", "national id", "identity number", "id card", "insurance number", "taxpayer", "licence", "person_id", "dni", "cpf", "nif", "steuer", "personal number", "citizen", "reisepass", "pasaporte"],
    3: "address live lives located ship deliver send visit home office house mail adresse dirección moved".split(),
}
ROLES = "colleague neighbour manager customer patient teacher doctor nurse driver boss reviewer author contact tester tenant lawyer accountant plumber landlord cousin friend uncle supervisor mr mrs ms dr prof".split()
DOES = "said told wrote asked found mentioned reported confirmed suggested called explained signed fixed noticed thinks works maintains lives replied helped opened reviewed promised insisted".split()
MEETS = "met asked told called thanked emailed phoned invited by with from for to and dear hi hello cc with named is thank".split()
OPENERS = "was is did has does can will ask tell please see met then so maybe perhaps mr mrs ms dr uncle aunt my our only even".split()
CLOSINGS = ["Regards", "Best regards", "Kind regards", "Thanks", "Thanks in advance", "Many thanks", "Cheers", "Best", "Best wishes", "Sincerely", "Yours", "Greetings", "Thx", "Grüße", "Viele Grüße", "Saludos", "Cordialement", "Merci", "Obrigado"]
BOTS = "noreply no-reply donotreply daemon root svc-build deploy-bot ci-bot postmaster mailer-daemon service-runner jenkins backup-job".split()
STAMPS = "commit trace tag build order version step page port ticket release digest row job run batch line level chapter item".split()
SYLLABLES = "ba be do fa gri hol ka lin mor ne pa quil ren sto tam ul ven wes yor zan bel cor dru fen hart mil osk per sal thor".split()
UPPER = "ABCDEFGHJKLMNPQRSTUVWXYZ"


class Grammar:
    def __init__(self, seed: int, given: list[str], streets: list[str]) -> None:
        self.rnd, self.given, self.streets = random.Random(seed), given, streets
        self.pick = self.rnd.choice

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p

    def d(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def num(self, a: int, b: int) -> str:
        return str(self.rnd.randint(a, b))

    def made(self, n: int) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(n))

    def shape(self, pattern: str) -> str:
        """``9`` a digit, ``A`` a capital letter, anything else itself."""
        return "".join(self.pick("0123456789") if c == "9" else self.pick(UPPER) if c == "A" else c for c in pattern)

    # ---- items

    def person(self) -> tuple[str, str]:
        first = (self.pick(self.given) if self.chance(0.75) else self.made(2)).title()
        last = self.made(self.rnd.randint(2, 4)).title()
        if self.chance(0.12):
            last = self.pick((f"O'{last}", f"{last}-{self.made(2).title()}", f"Mc{last}"))
        return first, last

    def name(self) -> str:
        a, b = self.person()
        return self.pick((f"{a} {b}",) * 6 + (f"{a} {self.pick(UPPER)}. {b}", f"{b}, {a}", f"{a} {self.made(2).title()} {b}", f"{a} {b}".upper(), f"{self.pick(UPPER)}. {b}" if self.chance(0.3) else f"{a} {b}"))

    def host(self) -> str:
        return f"{self.pick((self.made(2), self.made(3), f'{self.made(2)}-{self.made(2)}', f'{self.pick(("mail", "post", "corp", "uni", "staff"))}.{self.made(2)}'))}.{self.pick('com org net de fr es io co.uk example example.org test invalid edu info'.split())}"

    def email(self) -> str:
        a, b = (x.lower().replace("'", "") for x in self.person())
        local = self.pick((f"{a}.{b}", f"{a}_{b}", f"{a}{b}", f"{a}{self.num(1, 99)}", f"{a[0]}{b}", f"{b}-{a[0]}", f"{a}+{self.pick(NOUNS)}", a, b, f"{a}.{self.num(1950, 2010)}"))
        at, dot = self.pick((("@", "."),) * 8 + (("(at)", "."), (" [at] ", " [dot] "), (" AT ", " DOT "), (" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), ("{at}", "."), (" <at> ", ".")))
        made = local + at + self.host().replace(".", dot)
        return made.upper() if at == "@" and self.chance(0.06) else made.title() if at == "@" and self.chance(0.05) else made

    def phone(self) -> str:
        cc = self.num(1, 99)
        return self.shape(self.pick((f"+{cc} 99 9999 9999", f"+{cc} 999 999 999", f"+{cc}-999-999-9999", f"+{cc} (999) 999-9999", f"00{cc} 9999 999999", "(999) 999-9999", "999-999-9999", "999.999.9999", "999-9999", "999-9999 ext. 999", "(999) 999-9999 x999", "099 9999 9999", "0999 999999", "09999 999999", "0999-999999", "099/9999999", "099 99999 99", f"+{cc} 9 99 99 99 99", f"+{cc} 99 99999 999", "+1 999-9999", "09 99 99 99 99", f"+{cc}9999999999")))

    def identity(self) -> str:
        return self.shape(self.pick(("999-99-9999", "999-99-9999", "AA999999A", "AA 99 99 99 A", "AA-999-999-999", "A99999999", "A9999999", "AA9999999", "99999999-A", "99999999A", "A9999999A", "99.99.99-999.99", "999.999.999-99", "99 999 999 999", "999 999 999 99", "9999 9999 9999", "999999-9999", "9 99 99 99 999 999 99", "999999999", "AA99999999", "999 999 999")))

    def address(self) -> str:
        road = self.pick(self.streets)
        street = self.pick((self.made(3).title(), self.made(2).title(), f"{self.pick(('Old', 'Upper', 'New', 'North', 'East'))} {self.made(2).title()}"))
        town = self.pick((self.made(3).title(), f"{self.made(2).title()} {self.pick(PLACES)}"))
        n, dot = self.num(1, 999) + self.pick(("", "", "", "b")), self.pick(("", ".")) if len(road) < 4 else ""
        plain = f"{n} {street} {road}{dot}"
        return self.pick(
            (
                plain, f"{plain}, {town}", f"{plain}, {town}", f"{plain}, {town} {self.d(5)}", f"{plain}, {town}, {self.pick(UPPER)}{self.pick(UPPER)} {self.d(5)}", f"{plain}, Apt {self.num(1, 60)}, {town} {self.d(5)}",
                f"Flat {self.num(1, 60)}, {plain}, {town}", f"{self.num(1, 900)} rue {street}, {self.d(5)} {town}", f"Calle {street} {self.num(1, 900)}, {self.d(5)} {town}", f"Rua {street} {self.num(1, 900)}, {town}", f"{street.replace(' ', '')}{self.pick(('straße', 'weg', 'gasse', 'strasse', 'platz', 'allee'))} {self.num(1, 400)}, {self.d(5)} {town}",
            )
        )

    def look_alike(self) -> str:
        """What is no personal data but has parts of its form."""
        word, other, maker = self.pick(NOUNS), self.made(2), self.made(self.rnd.randint(2, 3)).title()
        ident = f"{self.pick(VERBS)}_{word}"
        version = f"{self.num(0, 9)}.{self.num(0, 130)}.{self.num(0, 30)}"
        camel = self.made(2).title() + self.made(2).title()
        return self.pick(
            (
                f"@{other}", f"git@{other}.{self.pick(('com', 'org', 'invalid', 'example'))}:{word}/{other}.git", f"{self.pick(('pg', 'amqp', 'redis', 'mysql', 'ftp'))}://{other}:{self.made(2)}@{other}.{self.pick(('internal', 'local', 'example'))}:{self.num(80, 9999)}/{word}",
                f"{self.pick(BOTS)}@{self.pick(('localhost', f'{other}.internal', f'build.{other}.local', f'{other}.example', self.host()))}", f"{self.pick(BOTS)}@{self.host()}", f"{ident}@{version}", f"{other}@{version}", f"{word}-{other}@{self.num(1, 20)}.{self.num(0, 9)}",
                version, f"{version}.{self.num(0, 9999)}", f"v{version}", f"{maker} {version}", f"{maker} {self.num(1, 12)}", f"{self.num(10, 223)}.{self.num(0, 250)}.{self.num(0, 99)}.{self.num(1, 250)}", f"192.0.2.{self.num(1, 250)}", f"10.{self.num(0, 99)}.{self.num(0, 99)}.{self.num(1, 250)}:{self.num(80, 9999)}",
                f"20{self.num(10, 29)}-{self.num(10, 12)}-{self.num(10, 28)} {self.num(10, 23)}:{self.num(10, 59)}:{self.num(10, 59)}", f"20{self.num(10, 29)}-0{self.num(1, 9)}-{self.num(10, 28)} {self.num(10, 23)}:{self.num(10, 59)}", f"{self.num(10, 28)}/{self.num(10, 12)}/20{self.num(10, 29)}", f"20{self.num(10, 29)}{self.num(10, 12)}{self.num(10, 28)}.{self.d(4)}", f"20{self.num(10, 29)}{self.num(1, 9)}{self.num(10, 28)}.{self.d(4)}",
                f"{self.pick(STAMPS)} {self.d(self.rnd.randint(6, 13))}", f"{self.pick(STAMPS)} {self.d(self.rnd.randint(6, 13))}", f"{self.pick(STAMPS)} {self.num(1, 999)}", f"#{self.d(self.rnd.randint(5, 8))}", f"{self.pick(UPPER)}{self.pick(UPPER)}{self.pick(UPPER)}-{self.d(3)}-{self.d(3)}", f"{other.upper()[:4]}-{self.d(4)}", f"{self.d(3)}c{self.d(2)}ab{self.d(4)}", "".join(self.pick("0123456789abcdef") for _ in range(self.pick((12, 32, 40)))), self.d(self.rnd.randint(9, 16)),
                f"/{word}/{self.d(7)}/v2", f"{self.num(100, 999)},{self.d(3)},{self.d(3)}", f"{self.d(5)},{self.d(5)},{self.d(5)}", f"{self.num(1, 900)} - {self.num(1000, 9000)} - {self.num(100, 900)}", f"{self.num(2, 900)} {camel} {word}s", f"{self.num(1, 99)} {maker} {word}s", f"{self.num(0, 59)}.{self.d(6)}", f"1{self.d(9)}.{self.d(3)}",
                camel, f"{camel}Error", f"{camel}.{ident}", f"{ident}({word}={self.num(1, 9)})", f"{maker} {self.pick(('Guide', 'Manual', 'Cloud', 'Server', 'Studio', 'Engine', 'Library', 'Team', 'Project', 'Setup', 'Company', 'Framework', 'Console'))}", f"the {maker} {self.made(2).title()} {word}", f"{self.pick(ADJECTIVES).title()} {self.pick(NOUNS).title()}", f"{self.pick(('Monday', 'Friday', 'March', 'October'))} {self.num(1, 30)}", f"{self.pick(('Windows', 'Linux', 'Docker', 'Python'))} {self.num(3, 22)}",
                f"{self.pick(('Upper', 'Lower', 'Inner'))} {self.pick(('Route', 'Level', 'Gate'))}, step {self.num(1, 900)}", f"page {self.num(1, 900)} {self.pick(NOUNS).title()} {self.pick(NOUNS).title()}", f"the {self.made(2).title()} {self.pick(self.streets)} {word}", f"{maker} {self.made(2).title()}: {word}",
            )
        )

    # ---- what stands around an item

    def words(self, n: int) -> str:
        if self.chance(0.12):
            small, nouns = ABROAD[self.pick(sorted(ABROAD))]
            return " ".join(self.pick(self.pick((small, small, nouns))) for _ in range(n))
        roles = (SMALL, ADJECTIVES, NOUNS, VERBS, LINKS, TIMES)
        return " ".join(self.pick(self.pick(roles)) for _ in range(n))

    def sentence(self) -> str:
        made = self.words(self.rnd.randint(3, 9))
        return made[0].upper() + made[1:] + self.pick((".", ".", "!", "?"))

    def cue(self, kind: int, often: float) -> str:
        if kind == 4:
            return self.pick(self.pick((ROLES, MEETS, MEETS))) if self.chance(often) else ""
        if not self.chance(often):
            return ""
        other = self.rnd.randrange(4) if self.chance(0.05) else kind
        return self.pick(CUES[other])

    def around(self, kind: int, often: float) -> tuple[str, str]:
        """The text before and after an item of a type; ``often``: how often a cue word stands before it."""
        cue, key = self.cue(kind, often), self.pick(NOUNS)
        form = self.rnd.randrange(10)
        if form == 0:
            return self.pick(("", "- ", "* ", "> ", "1. ", "| ", "  ")), self.pick(("", "", "\n", "\r\n", " |", ","))
        if form in (1, 2):
            label = (cue or key).replace(" ", self.pick((" ", "_"))) if kind < 4 else self.pick(("name", "author", "contact", "owner", "reviewer", "customer", "from", "cc", key))
            if self.chance(0.5):
                label = label[0].upper() + label[1:]
            return label + self.pick((": ", ": ", ":", "=", " = ", ' = "', '="', " - ", ' "')), self.pick(("", "\n", "\r\n", f" {self.words(2)}", f'" {key}', ";", f", {self.words(3)}"))
        if form == 3:
            label = (cue or key).replace(" ", "_")
            return self.pick((f'{{"{label}": "', f'{self.pick(VERBS)}({label}="', f'[{self.pick(VERBS)}] {key}={self.num(1, 9)} {label}=', f"<{key}>", f'<{key} {label}="', "(", "<")), self.pick(('", "ok": true}', '")', f" status={key}", f"</{key}>", '">', ")", ">"))
        lead = self.words(self.rnd.randint(1, 6))
        gap = self.pick(("", "", f" {self.pick(SMALL)}", f" {self.pick(LINKS)}", " is", " no.", " of"))
        head = f"{lead} {cue}{gap if cue and kind < 4 else ''}" if cue else f"{lead} {self.pick(LINKS)}"
        if kind == 2 and cue and self.chance(0.3):
            head = head.replace(cue, cue.upper())
        if kind == 4 and self.chance(0.3):
            head = self.pick((self.pick(OPENERS), self.pick(VERBS), self.pick(TIMES), self.pick(LINKS), self.pick(ROLES), self.pick(MEETS)))
        if form == 4:
            head = ""
        elif form == 5:
            head = f"{head},"
        head = head[:1].upper() + head[1:]
        tail = self.pick(DOES) if kind == 4 and self.chance(0.4) else self.words(1)
        after = self.pick((".", ".", ",", f" {tail} {self.words(self.rnd.randint(1, 5))}.", f", {self.words(3)}.", "!", f" {tail} {self.words(3)}?", f" {self.pick(LINKS)} {self.words(3)}.", "", f"; {self.words(2)}", ")"))
        if kind == 4 and self.chance(0.1):
            after = f"'s {self.words(3)}."
        return head + " " * bool(head), after

    def sign(self, item: str) -> str:
        closing = self.pick(CLOSINGS)
        closing = self.pick((closing, closing, closing.lower(), closing.upper()))
        end = self.pick(("", "", "\n", "\r\n", f" {self.sentence()}", f"\n{self.sentence()}", "<", "\\\\"))
        mark = self.pick(("", "", "", "> ", "* ", "- ", "\t", "1. "))
        return mark + self.pick((f"{closing}, {item}", f"{closing}, {item}", f"{closing},\n{item}", f"{closing}\n{item}", f"{closing}! {item}", f"{closing}. {item}", f"--\n{item}", f"-- {item}", f"{closing},\r\n\r\n{item}")) + end

    def spoken(self) -> tuple[str, list[tuple[int, str]]]:
        """A text with, for its true items, type and text."""
        kind = self.pick((0, 1, 2, 3, 4, 4, 4, 5, 6, 6, 6, 6, 6, 6))
        items: list[tuple[int, str]] = []
        if kind == 5:
            first = self.person()[0]
            name = self.pick((first, first, self.name()))
            made, items = self.sign(name), [(4, name)]
        elif kind == 6:
            thing = self.look_alike() if self.chance(0.8) else self.sentence()
            before, after = self.around(self.rnd.randrange(5), 0.15)
            made = before + thing + after
            if self.chance(0.15):
                made = made.upper()
        else:
            item = (self.email, self.phone, self.identity, self.address, self.name)[kind]()
            before, after = self.around(kind, (0.4, 0.75, 0.92, 0.4, 0.65)[kind])
            made, items = before + item + after, [(kind, item)]
        if self.chance(0.5):
            made = self.sentence() + self.pick((" ", "\n", "\r\n")) + made
        if self.chance(0.4) and made[-1:] in ".!?\n":
            made += self.pick((" ", "\n")) + self.sentence()
        return made, items
