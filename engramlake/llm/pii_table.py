"""The small labelled table the tagger is trained from.

Everything here is general knowledge: common given and family names of many countries, street and
town names by the word parts such names are made of, and the ways in which mail addresses, phone
numbers, identity numbers and street addresses are written. Sentences with slots, and runs of
dictionary words, surround them; half of all names are made up letter by letter, so that a name is
told by its surroundings and form. Everything is made with one seed: the model is the same in every session.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

KINDS = ("email", "phone", "id_number", "address", "name")
SEED, ROWS = 7, 6000

# Common given names.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Emily Oliver Charlotte Harry Alice "
    "George Emma Jack Sophie Liam Aoife Sean Niamh Ewan Isla Rhys Megan Hans Ursula Jürgen Monika Klaus Sabine Lukas Lena Maximilian Katharina Friedrich Heike Stefan Anja "
    "Pierre Camille Jean Chloé Louis Manon Antoine Léa Giuseppe Giulia Marco Francesca Luca Chiara Alessandro Elena José Carmen Antonio Lucía Javier Isabel Pablo Marta Diego Pilar Rafael Inés "
    "João Beatriz Tiago Mariana Willem Anouk Sven Astrid Lars Ingrid Erik Freja Mikkel Signe Olav Solveig Aino Mikko Piotr Agnieszka Jakub Zofia Tomáš Jana Milan Petra "
    "Ivan Olga Sergei Natalia Dmitry Svetlana Andriy Oksana Nikola Mila Giorgos Eleni Dimitris Katerina Mehmet Ayşe Mustafa Elif Emre Zeynep Ali Fatima Hassan Leila Omar Yasmin Khalid Amina "
    "Yosef Miriam Avi Tamar Reza Shirin Arjun Ananya Rahul Priya Vikram Kavita Imran Ayesha Wei Mei Jian Ling Hiroshi Yuki Takashi Sakura Haruto Min-jun Seo-yeon Minh Linh Nguyen Somchai Malee "
    "Budi Siti Kwame Ama Kofi Abena Chinedu Ngozi Emeka Adaeze Tunde Folake Juma Wanjiku Thabo Nomsa Desta Makeda Tane Moana"
).split()

# Common family names.
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Wilson Taylor Clark Walker Wright Murphy Kelly Byrne Campbell Stewart Evans Hughes Müller Schmidt Schneider Fischer Weber Wagner Becker "
    "Hoffmann Koch Bauer Richter Klein Wolf Schröder Martin Bernard Dubois Moreau Laurent Lefebvre Rossi Russo Ferrari Esposito Bianchi Romano Conti Hernández López Martínez González Pérez Sánchez "
    "Fernández Silva Santos Oliveira Costa Jansen Vries Bakker Visser Andersson Johansson Larsen Hansen Nielsen Virtanen Korhonen Kowalski Nowak Wójcik Novák Svoboda Horváth Nagy Popescu Ivanov Petrov "
    "Smirnov Kuznetsov Shevchenko Kovalenko Papadopoulos Yılmaz Demir Kaya Hussein Mansour Haddad Cohen Levi Hosseini Patel Sharma Singh Kumar Gupta Khan Iyer Wang Zhang Chen Tanaka Suzuki Yamamoto "
    "Kim Park Tran Pham Wibowo Mensah Owusu Okafor Adeyemi Okonkwo Mwangi Dlamini Tesfaye"
).split()

# Endings that family names of several languages have.
FAMILY_ENDS = "son sen sson berg stein mann bauer meier ström lund gren holm ton ham ford wood well worth by field man ley ini etti elli one ucci ez ado eiro ová ov ev in sky ski czak enko chuk ić escu opoulos akis oğlu ian yan dze vili ara moto yama gawa oka ulu iwe aux ier ard el er ert ing ock ott ell is as us ery ingham ick lin quist".split()

# First and last parts of street and town names, and words for streets.
STREET_WORDS = "Church High Station Victoria Queen King Park Mill Bridge Castle Market School Chapel Abbey Orchard Meadow Forest Lake Hill River Spring Garden Oak Elm Maple Cedar Pine Birch Willow Chestnut Main Second Third Washington Lincoln Jefferson Franklin Sunset Ridge Valley".split()
PLACE_STARTS = "Ash Bar Beck Black Brad Bur Cal Ches Clif Col Crow Dal Dor East Eden Fair Glen Grim Ha Har Hart Hol Kirk Lang Lin Long Mal Mor New North Ock Old Ox Pen Ply Ram Red Rose Sal Sea Shel South Stan Stock Stone Sut Thorn Tor Up Wal Ware West Whit Win Wood York".split()
PLACE_ENDS = "ton ham ford field worth wood well bury borough bridge mouth stead dale ley land minster port pool head gate wick by thorpe shire mere hurst combe ness".split()
TOWNS = (
    "London Leeds Bristol Glasgow Dublin Boston Chicago Denver Austin Portland Toronto Sydney Berlin Hamburg München Köln Leipzig Wien Zürich Paris Lyon Lille Madrid Sevilla Valencia Lisboa Porto Roma Milano Torino Napoli "
    "Amsterdam Utrecht Brussels Oslo Bergen Stockholm Helsinki Warsaw Prague Budapest Athens Istanbul Cairo Lagos Nairobi Mumbai Delhi Tokyo Osaka Seoul Lima Bogotá"
).split()
STREETS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Close Crescent Court Ct Way Drive Dr Terrace Boulevard Blvd Place Square Row Gardens Grove Hill Parade Walk Mews Highway Parkway Circus Green".split()
GERMAN = "straße strasse str. weg gasse allee platz ring damm ufer".split()
ROMANCE = ["rue", "rue de la", "rue du", "avenue de", "boulevard", "place de", "via", "viale", "corso", "piazza", "via della", "calle", "Calle de", "calle del", "avenida", "Avenida de la", "plaza", "paseo de", "rua", "rua da", "C/", "Avda.", "Pza.", "Rua do", "largo"]
HOSTS = "example.com example.org example.net test.com mail.com post.de correo.es web.de univ.edu dept.univ.edu charity.org.uk shop.co.uk studio.io labs.dev office.fr casa.it".split()
DOCUMENTS = [
    "passport", "passport number", "passport no.", "Passport No:", "ID card", "identity card", "identity card number", "ID number", "ID no.", "ID:", "national ID", "national identity number", "social security number", "SSN", "SSN:",
    "national insurance number", "NI number", "driving licence", "driver's license", "driving licence number", "licence no.", "tax ID", "tax number", "taxpayer number", "residence permit", "health insurance number", "insurance no.", "NHS number",
    "DNI", "NIE", "CPF", "PESEL", "Personalausweis", "Ausweisnummer", "Reisepass", "Steuer-ID", "Sozialversicherungsnummer", "pasaporte", "número de identidad", "documento de identidad", "codice fiscale", "numéro de sécurité sociale",
]

# Slots in braces; those named after a kind are labelled.
SENTENCES = """
Dear {name}, thank you for your letter of {date}.
Kind regards, {name}
Yours sincerely,\n{name}
From: {name} <{email}>
To: {email}
Cc: {email}, {email}
Name: {name}
Patient: {name}, born {date}
Applicant {name} applied on {date}.
Author: {name}. Title: {words}
{name} wrote the first chapter and {name} edited it.
The committee elected {name} as its chair.
According to {name}, {words} {words}.
{name} and {name} were married in {town}.
Professor {name} teaches {words}.
Mr {name} called while you were out.
Mrs {name} from {town} will pick it up.
We hired {name} in {month}.
This was painted by {name} in {year}.
our neighbour {name} feeds the cat
I spoke to {name} yesterday.
She works with {name} and with Professor {family}.
He asked Mr {family} and then Mrs {family}.
Thanks, {given}!
{given} said that {words} would be fine.
{given} and {given} went home early.
Is {given} coming too?
Tell {given} that the {words} are ready.
Dr {family} is away until {month}.
The {family} family sold the farm.
The {family} theorem and the {family} test are named after their authors.
My sister {name} plays the {words}.
His manager is called {name}.
Please forward this to {name} ({email}).
Witness statement of {name}, {address}.
{name} lives in {town}.
{name}; {phone}; {email}
{name} | {address} | {phone}
Emergency contact: {name}, {phone}
Participants: {name}, {name}, {name}
Invite {name}, {name} and {given}.
Minutes taken by {name}.
cc {name} on it
Her maiden name was {family}, now she is {name}.
Our guests were {name} of {town} and the {thing} {thing} team.
Met {name}; he knows {words}.
Email: {email}
E-mail {email} for details.
You can email me at {email}.
My address is {email}, please use it.
Send the file to {email} and {email}.
send it over to {email} thanks
Questions? {email}
Contact us: {email} / {phone}
Unsubscribe {email} from the newsletter.
Her work account {email} is blocked.
He signs in as {email}.
Phone: {phone}
Tel. {phone}
Mobile {phone} or office {phone}
Fax: {phone}
You can reach me on {phone} until {time}.
Dial {phone} and ask for {name}.
my number is {phone}
WhatsApp {phone}
Please ring back on {phone}.
His new phone number is {phone}, the old one was {phone}.
Customer service ({phone}) is open from {time}.
Telefon: {phone}
Teléfono {phone}
Mi número es {phone} y mi correo es {email}.
Meine Nummer ist {phone}.
Her {document} is {id_number}.
{document} {id_number}
{document}: {id_number}
{document} {id_number}, issued in {town}
Enter your {document} {id_number} here.
The clerk noted the {document} {id_number}.
I lost my {document} ({id_number}) in {town}.
ID {bare_id}
number {bare_id} in the register of persons
My identity number, {bare_id}, is wrong.
They wrote down {bare_id} as proof of identity.
Identification: {bare_id}
Mein {document} hat die Nummer {id_number}.
Su {document} es {id_number}.
The {document} office opens at {time}.
Renew the {document} before {month}.
A {document} is required, with a photo.
Address: {address}
The house at {address} is for sale.
He grew up at {address}.
Our office is located at {address}.
Ship to {address}
Please deliver it to {address} by {time}.
The party is at {address}, bring {words}.
Visit us: {address}.
we live in {address} now
Ich wohne in der {address}.
Vive en {address}.
J'habite {address}.
Abita in {address}.
Turn left into {road} and walk to {town}.
{road} was closed for {num} days.
The shops on {road} open at {time}.
Take the bus from {road} to {road}.
The {thing} {thing} Museum is near {road}.
Order {code} was shipped on {date}.
Ticket {code} is closed; see {code}.
Invoice no. {code} over {num} euros is due on {date}.
Error {code}: {words} failed at {time}.
Version {version} replaces {version}.
Upgraded {words} from {version} to {version}.
The server {ip} did not answer.
Ping {ip} took {num} ms.
Listening on {ip}:{num}
See {url} for more.
commit {hash} fixes {words}
Follow {handle} and {handle} for news.
thanks {handle} for the {words}
Operation {thing} {thing} starts in {month}.
Codename {thing} {thing}.
The {thing} {thing} release is due {date}.
{thing} {thing} is our oldest product.
The {thing} {thing} Company bought {thing} Systems.
The {thing} of {place} is a novel.
Population of {place}: {num}.
The {place} {thing} was postponed until {month}.
{place} {thing} costs {num} euros.
They signed the {place} {thing} in {year}.
We visited the {place} {thing} and the {thing} {place}.
my favourite is {place} {thing} with {words}
{place} lies between {place} and {place}.
We drove from {place} to {town} in {num} hours.
The road to {place} is {num} km long.
{place} won {score} against {place}.
Read chapters {num} to {num} of "{thing} and {thing}".
The meeting on {date} at {time} was cancelled.
{month} {num}, {year}: {words}
In {month} the {thing} {words} bloom.
Chapter {num}. {words}
It costs {num} dollars, or {num} with tax.
The value rose from {num} to {num} in {year}.
Row {num}, column {num}: {num}
Set x={num} and y={num} @ {num} Hz.
{num} people signed, {num} did not.
Size {num} x {num} x {num} cm
ISBN {isbn}
Flight {flight} leaves gate {num} at {time}.
Coordinates {num}.{num}, {num}.{num}
Lot {code}, batch {code}
Serial {serial}
Article {num} paragraph {num} applies.
{num}/{num} passed, {num} skipped
We meet at {time} at the {words}.
Look at {words} at once.
The {words} {words} is {words}.
{words}: {words}, {words} and {words}.
Why did {words} {words} so {words}?
Guten Morgen, wie geht es Ihnen heute?
Die Rechnung kam am {date} und war {num} Euro hoch.
Der Garten hinter dem Haus ist im {month} am schönsten.
Das Konzert in {place} beginnt um {time}.
La reunión del {date} fue muy larga.
El libro cuesta {num} euros en la tienda de {place}.
Ayer fuimos a {place} con los niños.
Me gusta cocinar arroz con verduras.
""".strip().splitlines()

# Plain prose, for background.
PROSE = """
The weather turned cold overnight and the pond froze for the first time this winter.
Most of the budget went into new chairs, because the old ones had started to break.
He repaired the bicycle with a piece of wire and a great deal of patience.
Nobody had read the manual, so the first attempt took twice as long as planned.
If the test fails again, roll back the change and open a new branch.
The recipe calls for two cups of flour, a pinch of salt and some warm milk.
Every spring the river rises a little and floods the lower fields.
Their train was late, which gave them time for another cup of coffee.
A small group of volunteers cleaned the beach before the tourists arrived.
The court held that the contract had never been valid in the first place.
Prices fell sharply last quarter, although demand stayed strong.
She learned to play the cello as an adult and never regretted it.
The doctor recommended more sleep, less coffee and a walk after lunch.
Water the tomatoes in the evening, never in the full sun.
Several samples were contaminated and had to be thrown away.
The second half was slow, but the home team scored just before the whistle.
It is easier to write a summary once the whole report is finished.
There is a spare key under the blue pot next to the door.
Our hotel had a view over the harbour and a very noisy lift.
They prefer short answers and do not like to be called before nine.
I would like to know whether the shop is open on public holidays.
The index was rebuilt after the disk had been replaced.
Children under ten travel free when an adult buys a ticket.
The old library has thick walls, so it stays cool in summer.
Please keep the answer brief and do not repeat the question.
The choir sang two encores and then everyone went home.
Half of the users never change the default settings.
An hour later the fog lifted and the mountains came into view.
Der Zug hatte Verspätung, deshalb kamen wir erst am Abend an.
Am Wochenende backen wir Brot und gehen im Wald spazieren.
Die neue Version läuft schneller und braucht weniger Speicher.
El médico le recomendó descansar y beber mucha agua.
Los vecinos plantaron árboles delante de la escuela.
La sopa estaba demasiado caliente y tuvimos que esperar.
""".strip().splitlines()


class Fill:
    def __init__(self, rng: random.Random, lexicon: Sequence[str], capitals: Sequence[str] = ()) -> None:
        self.r, self.lexicon, self.capitals = rng, list(lexicon) or ["thing", "place", "green", "table", "water"], list(capitals) or TOWNS

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def made_up(self, least: int = 1, most: int = 3) -> str:
        """A word of open and closed syllables in no particular language."""
        starts, vowels, ends = "b c d f g h j k l m n p r s t v w y z br ch dr fl gr kr pl qu sh sk sl st th tr".split(), "a e i o u a e i o u ai ee ia io ou ö ü á é".split(), ["", "", "", *"nrslmtkx", "nd", "rt", "ck"]
        return "".join(self.r.choice(starts) + self.r.choice(vowels) + self.r.choice(ends) for _ in range(self.r.randint(least, most))).capitalize()

    def family(self) -> str:
        x = self.r.random()
        if x < 0.2:
            one = self.r.choice(FAMILY)
        elif x < 0.3:
            one = self.r.choice(self.capitals).capitalize()
        else:
            one = self.made_up(1, 2) + (self.r.choice(FAMILY_ENDS) if x < 0.85 else "")
        x = self.r.random()
        if x < 0.05:
            return one + "-" + (self.r.choice(FAMILY) if self.r.random() < 0.3 else self.made_up(1, 2) + self.r.choice(FAMILY_ENDS))
        return self.pick("van ", "de ", "von ", "O'", "Mac", "Mc", "di ") + one if x < 0.1 else one

    def given(self) -> str:
        x = self.r.random()
        if x < 0.5:
            return self.r.choice(GIVEN)
        return self.r.choice(self.capitals).capitalize() if x < 0.75 else self.made_up(1, 3) + self.pick("", "", "a", "o", "e", "en", "ine", "y", "us")

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")

    def name(self) -> str:
        g, f = self.given(), self.family()
        x = self.r.random()
        if x < 0.55:
            n = f"{g} {f}"
        elif x < 0.72:
            n = f"{f}, {g}"
        elif x < 0.84:
            n = f"{self.initial()}. {f}"
        elif x < 0.92:
            n = f"{g} {self.initial()}. {f}"
        elif x < 0.95:
            n = f"{self.initial()}. {self.initial()}. {f}"
        elif x < 0.97:
            n = f"{f}, {self.initial()}."
        else:
            n = f"{g} {self.given()} {f}"
        x = self.r.random()
        if x < 0.12 and g in GIVEN:  # small letters only leave a name that is well known
            return n.lower()
        return n.upper() if x > 0.92 else n

    def place(self) -> str:
        x = self.r.random()
        if x < 0.35:
            return self.r.choice(TOWNS) if x < 0.25 else self.r.choice(self.capitals).capitalize()
        return self.r.choice(PLACE_STARTS) + self.r.choice(PLACE_ENDS) if x < 0.6 else self.made_up(1, 3) + self.pick("", "", "a", "o", "ia", "burg", "ville", "ora", "and")

    town = place

    def road_name(self) -> str:
        x = self.r.random()
        if x < 0.35:
            return self.r.choice(STREET_WORDS)
        if x < 0.65:
            return self.r.choice(PLACE_STARTS) + self.r.choice(PLACE_ENDS)
        return self.made_up(1, 3) if x < 0.85 else self.r.choice(FAMILY)

    def road(self) -> str:
        x = self.r.random()
        if x < 0.6:
            return self.road_name() + " " + self.r.choice(STREETS)
        return self.made_up(1, 2) + self.r.choice(GERMAN) if x < 0.8 else self.r.choice(ROMANCE) + " " + self.road_name()

    def house(self) -> str:
        return str(self.r.choice([self.r.randint(1, 40), self.r.randint(1, 400), self.r.randint(400, 9999)])) + self.r.choices(["", "a", "B", "c", "-" + str(self.r.randint(2, 99)), "/" + str(self.r.randint(1, 9))], [76, 6, 4, 4, 5, 5])[0]

    def postcode(self) -> str:
        d, a = self.digits, lambda n: "".join(self.r.choice("ABCDEGHLMNPRSTWXYZ") for _ in range(n))
        return self.pick(d(5), d(5), d(4), f"{a(2)}{d(1)} {d(1)}{a(2)}", f"{a(1)}{d(2)} {d(1)}{a(2)}", f"{a(2)} {d(5)}", f"{a(2)}{d(2)} {d(1)}{a(2)}", f"{d(4)} {a(2)}", f"{d(5)}-{d(3)}")

    def address(self) -> str:
        n, road, town, code = self.house(), self.road_name(), self.place(), self.postcode()
        x = self.r.random()
        if x < 0.5:
            flat = self.r.choices(["", f", Flat {self.digits(1)}", f", Apt {self.digits(2)}", f", Apt. {self.digits(1)}B", f", Unit {self.digits(1)}", f" #{self.digits(2)}", f", Suite {self.digits(3)}", f", {self.r.randint(1, 9)}th floor"], [55, 9, 9, 5, 7, 5, 5, 5])[0]
            tail = self.pick("", "", f", {town}", f", {town} {code}", f", {town}, {code}", f", {code} {town}", f"\n{town} {code}")
            first = self.r.choices(["", f"Flat {self.digits(1)}, ", "St ", "Old ", "Upper "], [78, 8, 5, 5, 4])[0]
            road = road if self.r.random() < 0.9 else road + " " + self.r.choice(STREET_WORDS)
            out = f"{first if first.startswith('Flat') else ''}{n} {'' if first.startswith('Flat') else first}{road} {self.r.choice(STREETS)}{flat}{tail}"
        elif x < 0.68:
            base = self.r.choice([self.made_up(1, 3), self.r.choice(FAMILY), self.pick("Haupt", "Bahnhof", "Schul", "Garten", "Berg", "Kirch", "Linden", "Goethe", "Mozart", "Ring", "Wald", "Mühlen")])
            way = self.r.choice(GERMAN)
            base = base + way if self.r.random() < 0.8 else base + self.pick(" ", "-") + way.capitalize()
            out = f"{base} {n}" + self.pick("", "", f", {self.digits(5)} {town}", f", {town}", f" in {self.digits(5)} {town}")
        elif x < 0.78:
            out = f"{n}{self.pick(' ', ', ')}{self.r.choice(ROMANCE[:6])} {road}" + self.pick("", "", f", {self.digits(5)} {town}", f", {town}")
        elif x < 0.96:
            out = f"{self.r.choice(ROMANCE)} {road}{self.pick(' ', ' ', ', ', ' n. ', ', nº ', ' nr. ')}{n}" + self.pick("", "", f", {self.digits(5)} {town}", f", {town}", ", 2º B")
        else:
            out = f"{self.made_up(1, 2)}{self.pick('straat', 'laan', 'vej', 'gatan', 'gata', 'veien', 'tie', 'katu', 'gade')} {n}" + self.pick("", f", {self.digits(4)} {town}")
        return self.r.choices([out, out.lower(), out.upper()], [82, 11, 7])[0]

    def email(self) -> str:
        g, f, w = re.sub(r"[^a-z]", "", self.given().lower()) or "a", re.sub(r"[^a-z]", "", self.family().lower()) or "b", self.word()
        s = self.pick(".", "_", "-", "")
        local = self.pick(f"{g}{s}{f}", f"{g}{s}{f}", f"{f}{s}{g}", f"{g[0]}{s}{f}", f"{g}{self.digits(self.r.randint(1, 4))}", f"{g}.{f}{self.digits(2)}", f"{g}+{w}", f"{g}.{f}+{w}", f"{w}", f"{w}{s}{w}", f"{f}{self.digits(2)}", f"{f}{s}{g[0]}", "info", "office", f"{g}.{self.initial().lower()}.{f}", f"{f}-{g[0]}.{w}")
        host = self.r.choice(HOSTS) if self.r.random() < 0.5 else self.pick("", "", "mail.", "smtp.", "staff.") + (re.sub(r"[^a-z]", "", self.made_up(1, 2).lower()) or "x") + "." + self.pick("com", "org", "net", "de", "es", "co.uk", "io", "edu", "info", "test", "example", "local", "eu")
        x = self.r.random()
        if x < 0.25:
            at = self.pick(" (at) ", " [at] ", " at ", "(at)", "[at]", " {at} ", " AT ", " <at> ", " (AT) ")
            dot = self.pick(".", ".", " dot ", " (dot) ", " [dot] ", "(dot)", "[dot]", " DOT ")
            out = local + at + host.replace(".", dot)
            return out if self.r.random() < 0.7 else out.replace(local, local.replace(".", dot))
        whole = f"{local}@{host}"
        return self.r.choices([whole, f"mailto:{whole}", f"<{whole}>", whole.upper(), f"({whole})"], [76, 8, 7, 6, 3])[0]

    def phone(self) -> str:
        d, r = self.digits, self.r
        x = r.random()
        if x < 0.3:  # international, in groups
            groups = r.choice([(3, 4), (2, 3, 4), (3, 3, 3), (2, 2, 2, 2), (4, 3, 3), (1, 2, 2, 2, 2), (4, 6), (10,), (3, 7), (2, 4, 4), (2, 5, 3), (3, 3, 4), (3, 3, 2, 2), (9,), (2, 8)])
            sep = self.pick(" ", " ", "-", ".", "")
            return self.pick("+", "+", "00", "(+") + (c := self.pick("1", "44", "49", "34", "33", "39", "31", "41", "43", "46", "48", "351", "353", "90", "91", "61", "55", "81")) + (")" if False else "") + (sep or self.pick("", " ")) + sep.join(d(n) for n in groups)
        if x < 0.55:  # North America
            a, b, c = d(3), d(3), d(4)
            return self.pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1 {a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"{a} {b} {c}", f"{b}-{c}", f"1 ({a}) {b} {c}", f"1.{a}.{b}.{c}", f"+1.{a}.{b}.{c}", f"{a}/{b}-{c}")
        if x < 0.75:  # Britain and Ireland
            return self.pick(f"020 {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(3)} {d(4)}", f"(0{d(3)}) {d(7)}", f"(020) {d(4)} {d(4)}", f"+44 (0){d(3)} {d(3)} {d(4)}", f"+44 (0) 20 {d(4)} {d(4)}", f"07{d(9)}")
        if x < 0.9:  # Germany and its neighbours
            return self.pick(f"0{d(2)}/{d(7)}", f"0{d(3)}/{d(6)}", f"0{d(2)} {d(7)}", f"0{d(3)}-{d(7)}", f"0{d(2)}/{d(4)}-{d(3)}", f"01{d(2)} {d(7)}", f"01{d(2)}/{d(8)}", f"0{d(3)} {d(2)} {d(2)} {d(2)}", f"({d(4)}) {d(6)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(2)}-{d(4)}-{d(4)}")
        return self.pick(f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"9{d(8)}", f"6{d(2)}-{d(3)}-{d(3)}", f"06 {d(4)} {d(4)}")

    def bare_id(self) -> str:
        """Identity numbers that their form alone gives away."""
        d, a = self.digits, self.initial
        return self.pick(
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{a()}{a()} {d(2)} {d(2)} {d(2)} {self.pick('A', 'B', 'C', 'D')}", f"{a()}{a()}{d(6)}{self.pick('A', 'B', 'C', 'D')}", f"{a()}{a()} {d(6)} {self.pick('A', 'B', 'C', 'D')}", f"{d(8)}{a()}", f"{d(8)}-{a()}",
            f"{self.pick('X', 'Y', 'Z')}{d(7)}{a()}", f"{self.pick('X', 'Y', 'Z')}-{d(7)}-{a()}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"756.{d(4)}.{d(4)}.{d(2)}", f"{d(6)}-{d(4)}",
        )

    def document_number(self) -> str:
        d, a, s = self.digits, self.initial, self.pick("-", " ", ".")
        return self.pick(
            self.bare_id(), f"{a()}{d(7)}", f"{a()}{d(8)}", f"{a()}{a()}{d(6)}", f"{a()}{a()}{d(7)}", f"{a()}{a()}{a()}{d(6)}", d(8), d(9), d(10), d(11), f"{d(2)}{a()}{a()}{d(5)}", f"{a()}{d(2)}{a()}{d(2)}{a()}{d(2)}", f"{d(3)}{s}{d(3)}{s}{d(3)}",
            f"{d(2)}{s}{d(3)}{s}{d(3)}", f"{d(4)}{s}{d(4)}{s}{d(4)}", f"{d(2)}.{d(3)}.{d(3)}-{d(1)}", f"{d(4)}-{d(6)}-{d(2)}", f"{d(2)} {d(6)} {a()} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"{a()}-{d(7)}", f"{d(2)} {d(3)} {d(3)} {d(3)}",
        )

    def document(self) -> str:
        return self.r.choice(DOCUMENTS)

    def word(self) -> str:
        return self.r.choice(self.lexicon)

    def rare(self) -> str:
        """A word of dictionary words and affixes, as rare words are."""
        a, b = self.word(), self.word()
        return self.pick(a + b, self.pick("un", "re", "over", "under", "pre", "anti", "sub", "mis", "out", "counter") + a, a + self.pick("ing", "ed", "ly", "ness", "er", "ers", "less", "ful", "al", "ment", "ation", "able", "ish", "s", "en", "ung", "ado", "ción", "wise", "ised"), a[: self.r.randint(3, 6)] + b[-self.r.randint(2, 5) :])

    def any_word(self) -> str:
        return self.word() if self.r.random() < 0.75 else self.rare()

    def words(self) -> str:
        return " ".join(self.any_word() for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def thing(self) -> str:
        return self.any_word().capitalize()

    def month(self) -> str:
        return self.pick("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

    def year(self) -> str:
        return str(self.r.randint(1890, 2030))

    def num(self) -> str:
        return self.pick(self.digits(1), self.digits(2), self.digits(3), self.digits(4), f"{self.digits(2)}.{self.digits(1)}", f"{self.digits(1)},{self.digits(3)}", f"{self.digits(3)} {self.digits(3)}", self.digits(self.r.randint(5, 9)))

    def date(self) -> str:
        y, m, d = self.year(), f"{self.r.randint(1, 12):02d}", f"{self.r.randint(1, 28):02d}"
        return self.pick(f"{y}-{m}-{d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{int(d)} {self.month()} {y}", f"{self.month()} {int(d)}", f"{m}/{d}/{y[2:]}", f"{y}-{m}-{d}T{d}:{m}:00Z", f"{y}{m}{d}")

    def time(self) -> str:
        return self.pick(f"{self.r.randint(0, 23)}:{self.r.randint(0, 59):02d}", f"{self.r.randint(1, 12)} pm", f"{self.r.randint(0, 23):02d}:{self.r.randint(0, 59):02d}:{self.r.randint(0, 59):02d}", f"{self.r.randint(1, 12)}.{self.r.randint(10, 59)}")

    def score(self) -> str:
        return f"{self.r.randint(0, 30)}{self.pick('-', ':')}{self.r.randint(0, 30)}"

    def code(self) -> str:
        d, a = self.digits, "".join(self.initial() for _ in range(self.r.randint(1, 4)))
        return self.pick(f"{a}-{d(4)}", f"{a}-{self.year()}-{d(4)}", f"#{d(5)}", d(5), f"{d(5)}-{d(4)}", f"{a}{d(5)}", f"{a}-{d(2)}-{d(5)}", f"{d(4)}-{d(2)}", f"0x{d(4)}", f"{a}/{d(3)}/{d(4)}", d(8), f"{a}-{d(6)}", d(11), f"{d(3)}{a}{d(3)}")

    def version(self) -> str:
        r = self.r.randint
        return self.pick(f"{r(0, 30)}.{r(0, 30)}.{r(0, 30)}", f"v{r(0, 30)}.{r(0, 30)}", f"{self.year()}.{r(1, 12):02d}.{r(1, 28):02d}-{r(1, 9999)}", f"{r(0, 30)}.{r(0, 30)}.{r(0, 30)}-rc{r(1, 9)}", f"{r(1, 30)}.{r(0, 300)}.{r(0, 30)}.{r(0, 9000)}", f"v{r(1, 9)}")

    def ip(self) -> str:
        r = self.r.randint
        return self.pick(f"{r(1, 255)}.{r(0, 255)}.{r(0, 255)}.{r(0, 255)}", f"10.0.{r(0, 255)}.{r(0, 255)}/24", f"fe80::{self.digits(4)}:{self.digits(4)}", f"00:1a:{self.digits(2)}:{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", f"{self.word()}.{self.word()}.internal")

    def url(self) -> str:
        return self.pick(f"https://{self.word()}.example.com/{self.word()}/{self.digits(3)}", f"www.{self.word()}.org", f"{self.word()}.com/{self.word()}", f"http://{self.word()}.net:8080")

    def hash(self) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(self.r.choice((7, 8, 12, 40))))

    def handle(self) -> str:
        return "@" + self.pick(self.word(), self.word() + self.digits(2), f"{self.word()}_{self.word()}", self.given().lower())

    def isbn(self) -> str:
        return f"978-{self.digits(1)}-{self.digits(3)}-{self.digits(5)}-{self.digits(1)}"

    def flight(self) -> str:
        return f"{self.initial()}{self.initial()} {self.digits(4)}"

    def serial(self) -> str:
        return self.pick(f"{self.initial()}{self.initial()}{self.digits(9)}", f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}-{self.digits(4)}", f"SN{self.digits(10)}")

    def salad(self) -> list[tuple[str, str]]:
        """Dictionary words with capitals, made-up words and numbers strewn in, and no finding."""
        out = []
        for _ in range(self.r.randint(4, 16)):
            x = self.r.random()
            out.append(self.any_word() if x < 0.68 else self.made_up(1, 3).lower() if x < 0.71 else self.thing() if x < 0.8 else self.place() + self.pick("", "", ",", ".", " " + self.thing()) if x < 0.9 else self.given() + self.pick("", "'s", ",") if x < 0.91 else self.num() if x < 0.95 else self.pick("the", "of", "at", "and", "in", "to", "from", "with", "de", "und"))
            if self.r.random() < 0.2:
                out[-1] += self.pick(",", ",", ",", ".", ";", ":")
        return [(" ".join(out) + self.pick("", "."), "")]

    def background(self) -> list[tuple[str, str]]:
        return [(self.r.choice(PROSE), "")] if self.r.random() < 0.5 else self.salad()

    def sentence(self, pattern: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for piece in re.split(r"(\{\w+\})", pattern.replace("\\n", "\n")):
            slot = piece[1:-1] if piece.startswith("{") else ""
            if not slot:
                out.append((piece, ""))
            elif slot == "id_number":
                out.append((self.document_number(), "id_number"))
            else:
                out.append((getattr(self, slot)(), "id_number" if slot == "bare_id" else slot if slot in KINDS else ""))
        return out

    def anywhere(self) -> list[tuple[str, str]]:
        """One finding in the midst of other text, for what tells it apart without its usual surroundings."""
        kind = self.r.choice((*KINDS, "name"))
        words = "".join(p for p, _ in self.background()).split(" ")
        at = self.r.randint(0, len(words))
        made = self.bare_id() if kind == "id_number" else getattr(self, kind)()
        before, after = self.pick(" ", " ", " ", ", ", ": ", " (", " - "), self.pick(" ", " ", " ", ", ", ". ", ") ", "; ")
        return [(" ".join(words[:at]) + before * (at > 0), ""), (made, kind), (after + " ".join(words[at:]), "")]


def labelled_rows(lexicon: Sequence[str] = (), capitals: Sequence[str] = (), rows: int = ROWS, seed: int = SEED) -> list[list[tuple[str, str]]]:
    """Texts as lists of (piece, kind or ''); lexicon and capitals: words a dictionary has in small letters, or only with a capital."""
    fill, out = Fill(random.Random(seed), lexicon, capitals), []
    for k in range(rows):
        row = fill.anywhere() if k % 2 else fill.sentence(SENTENCES[(k * 97) % len(SENTENCES)])
        if fill.r.random() < 0.45:
            row = [*fill.background(), (fill.r.choice([" ", " ", "\n", " / ", " - "]), ""), *row]
        if fill.r.random() < 0.4:
            row = [*row, (" ", ""), *fill.background()]
        case = fill.r.random()
        turn = str.upper if case < 0.05 else str.lower if case < 0.1 else str.title if case < 0.13 else str
        out.append([(turn(p), kind) for p, kind in row])
    return out
