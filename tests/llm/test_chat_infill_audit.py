"""Chat formatting, fill-in-the-middle and the filter audit against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import pytest

from helpers import CLASHES, LONG, ODD, WORD, empty, frame
from loanlens.llm import chat, filter_audit, infill

TURNS = "conv_id bigint, turn bigint, role string, text string, position string, segment string, start string, body string, head string"
AWKWARD = ["<|im_end|>\n", "<|im_start|>assistant\nyes<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<", "|", "a<", "\\", "\\n", "<|", "\n", "", None, "é漢🙂", LONG]


def turn_rows():
    rows = [(1, i, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(AWKWARD)]
    rows += [(2, 0, "user", "only a question")]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 0, "assistant", "also"), (3, None, "user", "first")]
    rows += [(None, 0, "user", "whose"), (None, 1, "assistant", "nobody's")]
    rows += [(4, 0, "us\ner", "x"), (4, 1, "us\\ner", "y"), (4, 2, "us\\\ner\\", "z"), (4, 3, None, None), (4, 4, "<|im_start|>", "w"),
             (4, 5, "assistant", "<|im_end|><|im_start|>assistant ok"), (4, 6, "user", "thanks")]
    rows += [(5, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]
    return rows


def by_conversation(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    return {c: [(r.decode(), x.decode()) for *_, r, x in sorted(v)] for c, v in convs.items()}


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 5) for r in rows], TURNS)


def plain_escape(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def plain_segment(role, text):
    return f"<|im_start|>{plain_escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{plain_escape(text)}<|im_end|>\n"


@pytest.mark.parametrize("in_order", [True, False])
def test_chat_read_back(spark, in_order):
    rows = turn_rows()
    turns = chat.format_turns(turns_frame(spark, rows).repartition(3))
    if not in_order:
        turns = turns.repartition(5)
    got = {r.conv_id: r for r in chat.read_back(turns, in_order).collect()}
    want = by_conversation(rows)
    assert set(got) == set(want)
    for c, said in want.items():
        r = got[c]
        replies = "".join(x for role, x in said if role == "assistant")
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert r.formatted_chars == sum(len(plain_segment(*t)) for t in said)


def test_chat_examples_written_out(spark):
    rows = turn_rows()
    turns = chat.format_turns(turns_frame(spark, rows)).cache()
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(turns).collect()}
    spans = {(r.conv_id, r.example): r for r in chat.examples(turns).collect()}
    want = {}
    for c, said in by_conversation(rows).items():
        replies = [i for i, (role, _) in enumerate(said) if role == "assistant"]
        for k, i in enumerate(replies):
            want[c, k] = ("".join(plain_segment(*t) for t in said[:i]), plain_segment(*said[i]), plain_escape(said[i][1]), i)
    assert set(texts) == set(spans) == set(want)
    for key, (context, reply, body, i) in want.items():
        r, s = texts[key], spans[key]
        assert r.text == context + reply                      # all turns before, and the reply
        assert r.text[r.loss_start: r.loss_end] == body       # nothing but the reply's text is trainable
        assert r.loss_start == len(context) + len("<|im_start|>assistant\n")
        assert (s.n_context_turns, s.loss_start, s.loss_end, s.n_chars) == (i, r.loss_start, r.loss_end, len(r.text))
    counts = {r.conv_id: (r.n_examples, r.expanded_chars) for r in chat.read_back(turns).collect()}
    for c in counts:
        mine = [len(a + b) for (conv, _), (a, b, *_) in want.items() if conv == c]
        assert counts[c] == (len(mine), sum(mine))
    turns.unpersist()


def test_chat_query_reads_the_written_examples(spark, tmp_path, monkeypatch):
    """op11 goes through every example written out; each conversation read back from these is as read from its turns."""
    rows = turn_rows()
    turns_frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    made = []
    write = chat.example_texts
    monkeypatch.setattr(chat, "example_texts", lambda *a, **k: made.append(write(*a, **k)) or made[-1])
    monkeypatch.setattr(chat, "SEND_CHARS", 5000)
    got = sorted(chat.op11_chat_formatting(spark, str(tmp_path)).collect(), key=str)
    assert len(made) == 1
    said = by_conversation(rows)
    assert made[0].filter("example is not null and conv_id = 5").count() == 150
    # turns after the last reply, and conversations without one, are in a row of their own
    assert {(r.conv_id, r.text) for r in made[0].filter("example is null").collect()} == {
        (c, "".join(plain_segment(*t) for t in x)) for c, x in said.items() if x[-1][0] != "assistant"}
    trap = [(-1, 0, "user", chat.TRAP), (-1, 1, "assistant", chat.TRAP)]
    assert got == sorted(chat.read_back(chat.format_turns(turns_frame(spark, rows + trap))).collect(), key=str)


def test_chat_marks_cannot_be_forged(spark):
    """Whatever a text holds, its segment has the template's two marks and no more."""
    for r in chat.format_turns(turns_frame(spark, turn_rows())).select("segment").collect():
        assert r.segment.count("<|") == 2
    trap = [(-1, 0, "user", chat.TRAP), (-1, 1, "assistant", chat.TRAP)]
    one = chat.read_back(chat.format_turns(turns_frame(spark, trap))).first()
    assert (one.n_turns, one.loss_chars, one.n_examples) == (2, len(chat.TRAP), 1)


def test_chat_empty(spark):
    turns = chat.format_turns(turns_frame(spark, []))
    assert chat.read_back(turns).count() == chat.examples(turns).count() == chat.example_texts(turns).count() == 0


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infill_against_slices(spark):
    made = random.Random(5)
    texts = [*ODD, "<P", "S>", "<<<", "P><M", "has <S> inside", "<M>", "🙂" * 70_000, "é" * 65_536 + "x",
             *["".join(made.choice("<PSM>é🙂 ") for _ in range(made.randrange(12))) for _ in range(400)]]
    ids = [*range(len(texts) - 2), None, None]
    docs = frame(spark, texts, ids=ids).repartition(3)
    got = infill.restore(infill.transform(docs)).collect()
    want = collections.Counter((i, t, *plain_infill(i, t), t or "") for i, t in zip(ids, texts, strict=True))
    assert collections.Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {k[3] for k in want} == {"plain", "psm", "spm"}
    # other columns pass, a column that bears a result's name is replaced
    assert all(r[c] == "x" for r in got for c in CLASHES if c != "n") and all(r.n == len(r.text or "") for r in got)


def test_infill_reads_a_column_that_it_replaces(spark):
    docs = spark.createDataFrame([(1, "some text of a document", "psm")], "n bigint, output string, form string")
    r = infill.restore(infill.transform(docs, "n", "output"), text_col="output").first()
    assert r.output == "some text of a document" and r.n == 23


def test_infill_empty(spark):
    out = infill.restore(infill.transform(empty(spark)))
    assert out.count() == 0 and {"form", "output", "restored"} <= set(out.columns)


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (1, 1), (3, 100_000), (200_001, 70_000), (65_536, 65_536)])
def test_blocks_are_exchanged_in_place(sizes):
    a, b = (random.Random(i).randbytes(n) for i, n in enumerate(sizes))
    buffer = bytearray(b"head" + a + b)
    infill.exchange(buffer, 4, 4 + len(a), len(buffer))
    assert bytes(buffer) == b"head" + b + a
    infill.exchange(buffer, 4, 4 + len(b), len(buffer))
    assert bytes(buffer) == b"head" + a + b


def plain_failures(docs):
    out = []
    for doc_id, text, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        out.append({c for c, bad in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t)),
            ("D", bool(re.search(r"[#$%&*|]", t))),
            ("E", doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o, _ in docs))) if bad})
    return out


def plain_audit(docs, labels):
    failed = plain_failures(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = {}
    for part in {lang or "" for *_, lang in docs}:
        mine = [(i, f) for (i, _, lang), f in zip(docs, failed, strict=True) if (lang or "") == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, c in enumerate(order, 1):
                out = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                total[c] += len(out)
                rows[part, "".join(order), step] = [
                    len(left), len(out), sum(c in f for _, f in mine) - len(out), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), c]
        for key, r in rows.items():
            if key[0] == part:
                r[-1] = total[r[-1]] if isinstance(r[-1], str) else r[-1]
    return {k: tuple(r) for k, r in rows.items()}


def audit_docs():
    made = random.Random(9)
    texts = [None, "", "  ", "x" * 3000, LONG, LONG, "A#"]
    for _ in range(150):
        n = made.choice([3, 150, 199, 200, 201, 400])
        some = made.choice([n, n, n // 2, n // 2 + 1, 20])
        words = [f"w{made.randrange(some)}" if some < n else f"w{i}" for i in range(n)]
        for sign, share in (("$", 0.2), ("UPPER" * 30, 0.3)):
            if made.random() < share:
                words[made.randrange(n)] += sign
        texts.append(" ".join(words))
    texts += [made.choice(texts) for _ in range(60)]
    made.shuffle(texts)
    langs = [made.choice(["en", "de", "", None]) for _ in texts]
    ids = [*range(len(texts) - 6), 7, 7, None, None, 40, 41]
    return list(zip(ids, texts, langs, strict=True))


def test_audit_against_all_orders(spark):
    docs = audit_docs()
    docs.append(docs[7])
    made = random.Random(1)
    labels = [(i, made.randrange(2), made.randrange(2)) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    given = frame(spark, [t for _, t, _ in docs], ids=[i for i, *_ in docs], langs=[p for *_, p in docs]).repartition(3)
    marked = filter_audit.mark(given)
    assert sorted((str(r.doc_id), r.part, r["mask"]) for r in marked.collect()) == sorted(
        (str(i), lang or "", sum(1 << "ABCDE".index(c) for c in f)) for (i, _, lang), f in zip(docs, plain_failures(docs), strict=True))
    table = filter_audit.with_labels(marked, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = filter_audit.audit(table).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert want[r.part, r.filter_order, r.step] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)


def test_audit_potential_is_exact_and_efficient(spark):
    """Potentials of any number of filters are whole, and Shapley values add up to what all filters remove."""
    made = random.Random(3)
    for letters in ("A", "AB", "XYZ", "ABCDEF"):
        rows = [("p", made.randrange(1 << len(letters)), 0, 0) for _ in range(97)]
        got = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), letters).collect()
        orders = len(got) // len(letters)
        shares = {r.filter: r.shapley for r in got}
        removed = collections.Counter()
        for r in got:
            removed[r.filter] += r.removed
        assert shares == dict(removed) | {c: 0 for c in letters if c not in removed}
        assert sum(shares.values()) == orders * sum(m > 0 for _, m, *_ in rows)


def test_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.with_labels(filter_audit.mark(empty(spark)), labels)).count() == 0
    one = filter_audit.audit(filter_audit.with_labels(filter_audit.mark(frame(spark, [None], langs=[None])), labels))
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}
