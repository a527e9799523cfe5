"""Near dedup against all pairs of real documents, by its own weights."""

import math
import re
from collections import Counter, defaultdict

from barlight.llm import near_dedup as N
from barlight.llm.tables import read

DATA = "/root/testdata/sf0.01"


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(N.WORDS, len(w)) or 1
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def test_classes_are_the_components_of_all_pairs(spark):
    docs = {r.doc_id: bag(r.text) for r in read(spark, DATA, "documents").select("doc_id", "text").collect()}
    where = defaultdict(list)
    for i, b in docs.items():
        for g in b:
            where[g].append(i)
    weight = {g: N.FLOOR + (1 - N.FLOOR) * min(1.0, math.log(len(docs) / len(ids)) / math.log(1 / N.RARE)) for g, ids in where.items()}
    size = {i: sum(weight[g] * n for g, n in b.items()) for i, b in docs.items()}
    label = {i: i for i in docs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    empty = [i for i, b in docs.items() if not b]
    for i in empty[1:]:
        label[max(top(i), top(empty[0]))] = min(top(i), top(empty[0]))
    for i, b in docs.items():
        common = defaultdict(float)
        for g, n in b.items():
            for j in where[g]:
                if j < i:
                    common[j] += weight[g] * min(n, docs[j][g])
        for j, c in common.items():
            if c / (size[i] + size[j] - c) >= N.THRESHOLD:
                links += 1
                a, z = sorted((top(i), top(j)))
                label[z] = a
    assert links > 50
    got = {r.doc_id: r.class_id for r in N.op3_near_dedup(spark, DATA).collect()}
    assert got == {i: top(i) for i in docs}
