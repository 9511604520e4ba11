"""Recall of near duplicates between texts that differ, against exact comparison of all documents of a table."""

import collections

from talus.llm import neardup
from talus.llm.common import shipped

SF = "/root/testdata/sf0.1"


def similar_pairs(sets, least=0.8):
    """All pairs of different sets at or above ``least``: those that share one of their rarest members, compared in full."""
    often = collections.Counter(x for s in sets for x in s)
    where, pairs = collections.defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        rare = sorted(sets[i], key=lambda x: (often[x], x))[: len(sets[i]) - -int(-least * len(sets[i]) // 1) + 1]
        for j in {j for x in rare for j in where[x] if len(sets[j]) >= least * len(sets[i])}:
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                pairs.append((i, j))
        for x in rare:
            where[x].append(i)
    return pairs


def test_pairs_of_different_texts_are_found(spark):
    shipped(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[frozenset(neardup.shingles(t).tolist())].append(d)
    sets = list(groups)
    pairs = similar_pairs(sets)
    kept = {r.doc_id for r in neardup.one_of_each(docs).select("doc_id").collect()}
    assert all(len(kept.intersection(own)) <= 1 for own in groups.values())  # copies
    missed = [(i, j) for i, j in pairs if kept.intersection(groups[sets[i]]) and kept.intersection(groups[sets[j]])]
    print("pairs of different texts", len(pairs), "both kept", len(missed))
    assert len(pairs) >= 30 and len(missed) <= 0.1 * len(pairs)
    near = {i for p in pairs for i in p}
    assert all(kept.intersection(own) for i, (s, own) in enumerate(groups.items()) if i not in near)  # nothing else goes
