import hashlib

from flowlark.llm import fingerprints as f


def test_likeness_of_edits():
    text = " ".join(f"w{i * i % 7919}" for i in range(900))
    a, b, c = f.fingerprint(text.encode()), f.fingerprint((text[:2000] + "XX" + text[2000:]).encode()), f.fingerprint(text[::-1].encode())
    assert a == f.fingerprint(text.encode()) and f.likeness(a, a) == 1
    assert f.likeness(a, b) > 0.9 and f.likeness(a, c) < 0.15
    assert f.likeness(a, f.fingerprint(b"")) == 0 and f.likeness("0::", "0::") == 1


def test_patterns_and_short_texts():
    for data in (b"a", b"ab" * 5000, b"\0" * 100_000, bytes(range(256)) * 300):
        k, a, b = f.fingerprint(data).split(":")
        assert len(a) // 2 <= 5 * 64 and len(b) <= len(a) + 2
    assert f.likeness(f.fingerprint(b"Is onhe. " * 700), f.fingerprint(b"Is onhe. " * 350 + b"something else altogether " * 120)) > 0.2


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: -r[0])
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        yield i, len(t), hashlib.sha256(e.encode()).hexdigest(), f.fingerprint(t.encode()), f.likeness(f.fingerprint(t.encode()), f.fingerprint(n.encode()))


def test_next_documents(docs):
    for buckets in (1, 7, 300):
        got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in f.compare_with_next(docs, buckets).collect())
        assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(odd_docs, no_docs):
    rows = f.compare_with_next(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_edited <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == "0::" and by[1].fingerprint == by[5].fingerprint
    assert f.compare_with_next(no_docs).count() == 0
    out = f.add_fingerprints(odd_docs, out="x")
    assert out.count() == odd_docs.count() and out.columns.count("x") == 1
