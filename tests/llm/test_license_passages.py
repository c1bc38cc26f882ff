"""Licence notices that are wrapped, or lie within a longer line, against all runs of words."""

import random
import re
import textwrap

import pytest

from tidewire.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(m.unit, m.license) for m in r.matches] for r in rows}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_templates_in_longer_texts(spark, prefix):
    texts = []
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        notice = "\n".join(textwrap.wrap(template, 28 if len(template) < 200 else 70, initial_indent=prefix, subsequent_indent=prefix))
        texts.append(f"{prefix}Copyright 2020 Some One\n{prose(k, 9)}\n{notice}\n" + "\n".join(prose(k + 90 + j, 12) for j in range(3 + len(template) // 20)))
    got = found(spark, texts)
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        assert (2, name) in got[k], (k, name, got[k])


def test_sentence_in_a_longer_line(spark):
    texts = [
        "Copyright 2020 X. Released under the MIT License. More text",
        f"{prose(1, 40)} licensed under\nCC BY-SA 4.0, {prose(2, 40)}",
        f"{prose(3, 30)} released under the {prose(4, 3)} MIT license. {prose(5, 30)}",
        f"{prose(6, 300)} {licenses.TEMPLATES[15][1]} {prose(7, 60)} {licenses.TEMPLATES[3][1]} {prose(8, 10)} {licenses.TEMPLATES[15][1]}",
    ]
    got = found(spark, texts)
    assert got[0] == [(0, "MIT")] and got[1] == [(0, "CC-BY-SA-4.0")] and got[2] == []
    assert sorted(got[3]) == [(0, "Apache-2.0"), (0, "MIT"), (0, "MIT")]


def test_part_of_a_notice_before_the_whole_one(spark):
    mit = licenses.TEMPLATES[15][1]
    text = f"{prose(1, 200)}\n{mit[: len(mit) // 2]}\n{prose(2, 60)}\n{mit.replace('. ', f'.{chr(10)}')}\n{prose(3, 300)}"
    assert found(spark, [text])[0] == [(3, "MIT")]


def test_runs_are_the_best_of_all(spark):
    rng = random.Random(5)
    templates = (("A", "a b c d e f g a b h"), ("B", "k l m n"))
    index = licenses.TemplateIndex(templates)
    sets = {name: ({*zip(t.split(), t.split()[1:])}, int((len(t.split()) - 1) / index.ratio + 1e-9)) for name, t in templates}
    texts = []
    for _ in range(150):
        words = rng.choices("abcdefghklmnxyz", k=12)
        for _, t in templates:
            part = t.split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "x"
            if rng.random() < 0.5:
                part.insert(rng.randrange(len(part) + 1), rng.choice("abxy"))
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        texts.append(" ".join(words))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    hits = 0
    for r in rows:
        pairs = list(zip(texts[r.doc_id].split(), texts[r.doc_id].split()[1:]))
        for name, (want, span) in sets.items():
            runs = [set(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + span) + 1)]
            best = max(2 * len(s & want) / (len(s) + len(want)) for s in runs)
            mine = max((m.dice for m in r.matches if m.license == name), default=0)
            assert mine == pytest.approx(best) if best >= 0.9 else mine == 0
            hits += best >= 0.9
    assert hits > 50
