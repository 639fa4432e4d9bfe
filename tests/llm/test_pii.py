import random
import re
from collections import Counter

import pytest

from engramlake.llm import pii, pii_table


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def kinds(tagger, text):
    return [(k, text[a:b]) for a, b, k in tagger.find([text])[0]]


def test_held_out_rows(tagger):
    rows = pii_table.labelled_rows(*pii.lexicon(tagger.classes), 400, seed=99)
    hit = wrong = missed = 0
    for row in rows:
        text = "".join(p for p, _ in row)
        want = [k for _, k in row if k and pii.sound(k, _)]
        got = [k for _, _, k in tagger.find([text])[0]]
        for k in pii_table.KINDS:
            g, w = got.count(k), want.count(k)
            hit, wrong, missed = hit + min(g, w), wrong + max(0, g - w), missed + max(0, w - g)
    # half of the rows put a finding amid other text, where nothing around it helps
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.85


# Written by hand: no frame, name, street or host of these is in the table.
UNSEEN = """
Yesterday the plumber, [name:Gustavo Bellweather], left his drill in our hallway.
Could you ask [name:Henrietta Molnarova] whether the violin has been tuned?
The prize went to [name:Rosalind Achterberg] for her work on moss.
I borrowed the tent from [name:Callum Fotheringay] last summer.
[name:Benedikt Oyelaran] will present the results after lunch.
Our goalkeeper [name:Matilda Kvistgaard] broke a finger on Sunday.
A letter from [name:T. Vandermolen] arrived without a stamp.
The old map belonged to [name:Percival J. Rowntree], who collected them.
[name:Quillfeather, Desmond] is third on the waiting list.
We named the boat after [name:Winifred Tamblyn].
The lecture by [name:Ottoline Grzybowska] was recorded.
Please give the parcel to [name:Leandro Castelhano] on the second floor.
If the pump stops, write to [email:gustavo.bellweather@pumpworks.biz] at once.
The draft is with [email:henrietta_m@riverpaper.press] for comments.
Backups are announced by [email:night-crew@vaultbarn.coop] every Friday.
Use [email:matilda (at) kvistgaard (dot) dk] for anything private.
Somebody registered with [email:c.fotheringay77@mailnest.me] twice.
My spam goes to [email:throwaway [at] boxmail [dot] net] these days.
The invoice went to [email:ACCOUNTS@HARBORTOOLS.COM] by mistake.
Ask [email:rosalind at achterberg dot org] for the slides.
Their hotline, [phone:+44 1632 960 457], was busy all morning.
If you get lost, try [phone:(614) 555-0142] first.
Grandma still answers [phone:0161 496 0732] herself.
The taxi firm changed its number to [phone:+1-202-555-0173] in spring.
Text me at [phone:07700 900461] when the film ends.
The bakery can be reached under [phone:030/23125-118] before seven.
He scribbled [phone:01 99 00 47 12] on a napkin.
Leave a message at [phone:+49 30 23125 447] please.
The form needs your passport [id_number:K4419027] in block letters.
Her social security number [id_number:078-05-1120] was printed on the card.
Somebody copied my identity card number [id_number:L22004417] from the desk.
The bank asked for [id_number:QQ 41 55 17 C] and a photo.
He carries an ID card with the number [id_number:53081964Q] on it.
Her driving licence number is [id_number:MORG753116] according to the file.
The hospital filed him under [id_number:943-20-7716] by accident.
My tax ID is [id_number:42 817 503 966] as far as I know.
The piano stands at [address:17 Fernhollow Road] for now.
Bring the chairs to [address:203 Larkspur Avenue, Flat 4] before noon.
She rents a studio at [address:8 Old Tannery Lane, Wexmoor].
The workshop moved to [address:Lindwurmstraße 44, 80337 München] in May.
They met at [address:Calle Olivares 12] after the concert.
Snow blocked the drive of [address:91 Cobblestone Court] again.
Our depot is at [address:1450 Granary Boulevard, Unit 6] next to the canal.
The clinic at [address:via Garofalo 31] closes early.
Bolts of size 48210-7719 are sold out.
Nobody has answered ticket HD-20931 since 2024-11-03.
The firewall dropped packets from 198.51.100.27 at 04:12:55.
Release 3.14.2 fixes the crash in build 20931.
@weekly and @nightly jobs share one queue.
Project Velvet Thunder begins in April.
The Marble Arch festival lasts nine days.
Winifred laughed and went upstairs.
We paid 1,250 crowns for 36 bottles of plum juice.
Grapes from Belmora are sweeter than those from Castrano.
"""


def test_unseen_names_and_frames(tagger):
    hit, wrong, missed = Counter(), Counter(), Counter()
    for line in UNSEEN.strip().splitlines():
        mark = re.search(r"\[(\w+):(.+?)\](?= |\.|,|$)", line)
        want = Counter([mark[1]] if mark else [])
        text = line.replace(mark[0], mark[2]) if mark else line
        got = Counter(k for _, _, k in tagger.find([text])[0])
        for k in pii_table.KINDS:
            hit[k] += min(want[k], got[k])
            wrong[k] += max(0, got[k] - want[k])
            missed[k] += max(0, want[k] - got[k])
    # forty-eight findings; single kinds have too few for a bound of their own
    assert sum(hit.values()) >= 0.8 * (sum(hit.values()) + sum(missed.values()))
    assert sum(hit.values()) >= 0.95 * (sum(hit.values()) + sum(wrong.values()))


def test_pruning_changes_nothing(tagger):
    texts = ["".join(p for p, _ in row) for row in pii_table.labelled_rows(*pii.lexicon(tagger.classes), 150, seed=5)]
    together = tagger.find(texts)
    random.Random(0).shuffle(order := list(range(len(texts))))
    for k in order[:40]:
        assert tagger.find([texts[k]])[0] == together[k]


def test_traps(tagger):
    for text in ("Bolts of lot 48210-7719 are gone.", "Back on 2026-08-14 at 18:30.", "The router 192.0.2.14 replied within 40 ms.", "Tag it with @curator and @weekly.", "Rowntree laughed.", "Invoice INV-2026-00417 was paid."):
        assert kinds(tagger, text) == []
    assert kinds(tagger, "Write marta+garden (at) example (dot) net or call 020 7946 0123.") == [("email", "marta+garden (at) example (dot) net"), ("phone", "020 7946 0123")]


def test_operator(spark):
    rows = [("a", "We hired Marta Fernhollow in May. Ring 614-555-0197 or leave a note."), ("b", None), ("c", "  "), ("d", ""), ("e", "word " * 40_000), ("a2", "We hired Mar\u200bta Fernhollow in May.")]
    df = spark.createDataFrame(rows, "k string, text string").selectExpr("*", "1 as kind", "2 as nth", "3 as tokens")
    got = {(r["k"], r["kind"], r["nth"]) for r in pii.found(df, ["k"], "text").collect()}
    assert got == {("a", "name", 1), ("a", "phone", 1), ("a2", "name", 1)}
    out = {r["k"]: r["redacted"] for r in pii.redacted(df, "text").collect()}
    assert out["a"] == "We hired [NAME] in May. Ring [PHONE] or leave a note." and out["b"] is None and out["c"] == "  " and out["e"] == rows[4][1]
    assert pii.found(df.where("false"), ["k"], "text").count() == 0
