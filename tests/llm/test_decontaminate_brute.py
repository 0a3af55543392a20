"""Decontamination against a plain walk over all documents, items and shifts."""

import random
import re

import pytest

from cytoloom.llm import decontaminate as dec

UNITS = {u.lower() for u in dec.UNITS}
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")


def tokens(text):
    """(template, value) of each token of texts of plain words, numbers, units and names."""
    out, end, number = [], 0, False
    for m in TOKEN.finditer(text or ""):
        t = m.group()
        if t[0].isdigit():
            out.append(("q", t))
            number = True
        else:
            near = text[end : m.start()] in ("", " ")
            inside = m.start() >= 2 and text[m.start() - 1] == " " and (text[m.start() - 2].islower() or text[m.start() - 2].isdigit() or text[m.start() - 2] in ",;:)")
            if number and near and t.lower() in UNITS:
                out.append(("u", t.lower()))
            elif t[0].isupper() and inside:
                out.append(("n", t.lower()))
            else:
                out.append((t.lower(), None))
            number = False
        end = m.end()
    return out


def plain(docs, items, window=dec.WINDOW, coverage=dec.COVERAGE):
    found = set()
    for d, text in docs:
        a = tokens(text)
        for i, bench in items:
            b = tokens(bench)
            if not a or not b:
                continue
            k = min(window, len(b))
            n = len(b) - k + 1
            covered = set()
            for shift in range(-len(b), len(a)):
                at = [p for p in range(n) if 0 <= p + shift <= len(a) - k and all(x[0] == y[0] for x, y in zip(b[p : p + k], a[p + shift : p + shift + k]))]
                slots = {(b[p + j], a[p + shift + j]) for p in at for j in range(k) if b[p + j][1] is not None}
                if at and len({x for x, _ in slots}) == len(slots):
                    covered |= set(at)
            if covered and len(covered) >= max(1, -(-n * coverage // 1)):
                found.add((d, i, len(covered), n))
    return found


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(17)
    words = [f"{a}{b}" for a in ("ban", "tor", "mil", "ges", "pon") for b in ("a", "ek", "ul", "ir", "os", "ay")]
    names = ["Alma", "Berit", "Carlo", "Dmitri"]

    def sentence(n):
        out = [rng.choice(words)]
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.12 else f"{rng.randint(1, 99)} {rng.choice(['kg', 'hours'])}" if x < 0.2 else str(rng.randint(1, 999)) if x < 0.28 else rng.choice(words))
        return " ".join(out)

    items = [(i, sentence(rng.choice((3, 6, 9, 20, 30)))) for i in range(14)] + [(90, None), (91, ""), (92, "...")]

    def other_values(text):
        swap = dict(zip(names, rng.sample(names, 4)))
        numbers: dict = {}
        text = re.sub("|".join(names), lambda m: swap[m.group()], text)
        return re.sub(r"\d+", lambda m: numbers.setdefault(m.group(), str(1000 + len(numbers))), text)

    docs = []
    for d in range(90):
        text = sentence(rng.randint(5, 25))
        bench = rng.choice(items[:14])[1]
        if d % 3 == 0:
            text += " " + bench + " " + sentence(4)
        elif d % 3 == 1 and d % 2:
            text += " " + other_values(bench)
        elif d % 5 == 0:  # slots that contradict one another
            text += " " + re.sub(r"\d+", lambda m: str(rng.randint(1000, 9999)), bench)
        elif d % 7 == 0:
            text += " " + bench[: len(bench) // 2]
        docs.append((d, text))
    return [*docs, (200, None), (201, ""), (3, docs[3][1])], items


def test_find_equals_the_plain_walk(spark, tables):
    docs, items = tables
    got = dec.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = plain(docs, items)
    assert {(r.doc_id, r.item_id, r.windows, r.item_windows) for r in got} == want and len(want) > 30


@pytest.mark.parametrize("extra", ["id", "__id", "__hash", "HASH"])
def test_clashing_columns_stay(spark, tables, extra):
    docs, items = tables
    table = spark.createDataFrame([(d, t, "own") for d, t in docs], f"doc_id bigint, text string, `{extra}` string")
    kept = dec.drop_found(table, spark.createDataFrame(items, "item_id bigint, text string"))
    found = {d for d, *_ in plain(docs, items)}
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in found)
