import random

import pytest

from tidewire.llm import cues, subjects

TALK = {
    "law": "judge verdict appeal witness lawsuit attorney jury bail courtroom plaintiff tribunal affidavit".split(),
    "sport": "referee goal match penalty goalkeeper tournament striker offside league medal sprint trophy".split(),
    "cooking": "garlic oven broth dough skillet parsley butter whisk recipe simmer pastry cinnamon".split(),
}
FRAMES = ["Did you see the {}?", "We need another {} before noon.", "What happened to the {}?", "Nobody told me about the {}.", "It is all about the {}.", "Without the {} there is no deal."]
FILLER = ["Come on, we are late.", "Who left the door open?", "Wait here, will you?", "Maybe tomorrow, maybe never.", "It was raining when she called.", "You look tired tonight.", "Give me one good reason.", "My sister lives across the river.", "I thought you would be taller.", "Let us start over."]


def subtitle(r, share, n=20):
    """share: subject -> cues that talk about it."""
    said = [r.choice(FRAMES).format(r.choice(TALK[s])) for s, k in share.items() for _ in range(k)]
    said += [r.choice(FILLER) for _ in range(n - len(said))]
    r.shuffle(said)
    said += ["Join pitchside: save 20% on your bank card, garlic and referee", "Pitchside.example pays for your coffee", "[judge coughs]", "[judge coughs]"]
    said += [f"Play at pitchside and win {r.randrange(900)} on your bank card: www.pitchside.example"]
    return "\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(said))


@pytest.fixture(scope="module")
def corpus():
    r, out = random.Random(8), []
    for k in range(700):
        picked = r.sample(sorted(TALK), r.choice([0, 1, 1, 2]))
        share = {s: r.randint(7, 9) for s in picked}
        stray = {s: r.randint(0, 2) for s in TALK if s not in picked and r.random() < 0.3}
        out.append((k, subtitle(r, share | stray), set(picked) or {"none"}))
    return out


def test_cues():
    text = "WEBVTT\r\n\r\n1\r\n00:01.000 --> 00:02.000\r\n<i>MAN 2: Hello\r\nthere.</i>\r\n2\r\n0:00:03,00-->0:00:04,00\r\n[THUNDER]\r\n\r\n00:00:05,000 ––> 00:00:06,000\r\n♪ la la ♪ Good bye\r\n\r\n4\r\n00:00:07,000 -> 00:00:08,000\r\nSubtitles by someone - www.some.example"
    raw = cues.split_cues(text)
    assert len(raw) == 4
    assert [cues.speech(c) for c in raw] == [["hello", "there"], None, ["good", "bye"], ["@", "subtitles", "by", "someone", "www", "some", "example"]]
    assert [cues.has_address(x) for x in ("w w w . some . example", "ads@some.example", "https://a.b/c", "some.example", "The end.Begin", "It was 5.30 p.m.", "Wait... here")] == [True, True, True, True, False, False, False]
    assert cues.split_cues("") == [] and cues.split_cues("no times here") == []


def test_repair():
    s = "1\n00:00:01,000 --> 00:00:02,000\nÇa alors, déjà minuit ! Peut-être"
    assert cues.repaired(s) == s
    once = s.encode().decode("cp1252", "replace")
    assert cues.repaired("été déjà".encode().decode("latin-1")) == "été déjà"
    assert "déj" in cues.repaired(once)
    ru = "Подожди здесь, мы опаздываем"
    assert cues.repaired(ru) == ru and cues.repaired(ru.encode("cp1251").decode("latin-1")) == ru


def test_held_out_accuracy(spark, corpus):
    train, test = corpus[:500], corpus[500:]
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in corpus] + [(9001, None, None), (9002, "", None), (9003, "plain text, no cues", None), (9004, "1\n00:00:01,000 --> 00:00:02,000\n" + "Wait here, will you? " * 50_000, None)], "doc_id bigint, text string, subjects string")
    labels = [(k, f" {s.upper()}" if k % 5 == 0 else s) for k, _, ls in train for s in ls] + [(train[0][0], None), (None, "law"), (train[1][0], "unknown")]
    labels = spark.createDataFrame(labels + labels[:50], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(i, s) for i, s in enumerate(sorted(TALK))], "subject_id int, subject string")
    models = subjects.fitted(docs, labels, areas)
    found = subjects.classify(docs, models)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(corpus) + 4 and all(got[k].subjects == [] for k in (9001, 9002, 9003, 9004)) and got[9004].spoken == 1
    pairs = [(set(got[k].subjects), ls - {"none"}) for k, _, ls in test]
    hits, said, true = sum(len(a & b) for a, b in pairs), sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs)
    assert hits / said > 0.97 and hits / true > 0.97
    c = {r.subject: r.documents for r in subjects.composition(found).collect()}
    assert c["none"] == sum(not r.subjects for r in got.values())


def test_unspoken_is_learnt_from_addresses(corpus):
    """Cues that share words with those that have an address are no speech, whatever they speak of; their form is not given."""
    r, texts, labels = random.Random(2), [], []
    brands = ["pitchside", "linecast", "subnest"]
    for _, t, ls in corpus[:500]:
        b = r.choice(brands)
        adverts = [f"Mirrored for you by {b}.example", f"Free films from the {b} club at www.{b}.example", f"{b} club - free films by garlic code {r.randrange(900)}"]
        texts.append(t + "".join(f"\n\n00:10:00,000 --> 00:10:01,000\n{x}" for x in adverts))
        labels.append(ls)
    m = subjects.train(texts, labels, sorted(TALK))
    cue = lambda x: f"\n\n00:10:00,000 --> 00:10:01,000\n{x}"
    said = [cue("Wait here, will you?") * 6 + cue("We need another dough before noon.") * 2, cue("linecast club - free films by garlic code 77") * 4 + cue("Wait here, will you?") * 6]
    spoken, owner, number, scores = [], [], {}, []
    for k, t in enumerate(said):
        for words in subjects._cues_of(t):
            for w in words:
                if w not in number:
                    number[w] = len(scores)
                    scores.append(m.word(w))
            spoken.append([number[w] for w in words])
            owner.append(k)
    import numpy as np

    share, n = subjects.text_shares(subjects._sums(subjects.evidence(np.array(scores)), spoken), np.array(owner), 2, m.live)
    assert abs(share[0, 0] - 0.25) < 0.03 and share[1].max() < 0.05 and n.round().tolist() == [8, 6]


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(1, "law")], "subject_id int, subject string")
    models = subjects.fitted(docs, labels, areas)
    assert subjects.classify(docs, models).count() == 0
    some = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\nhello")], "doc_id bigint, text string")
    assert subjects.classify(some, models).first().subjects == []
