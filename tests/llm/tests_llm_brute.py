"""Plain versions of what pipeline stages keep."""

from test_documents import brute_components


def brute_pipeline(rows):
    """Ids after language ID and near-duplicates."""
    language = [r for r in rows if r[1] and r[1].strip() and r[0] != 101]
    after = brute_components(language)
    return [sorted(r[0] for r in language), sorted(d for d, (_, c) in after.items() if d == c)]


def brute_fingerprint(text, anchors, chain=3):
    """Chains of a text's content words after anchors, by a loop over its words, as tuples."""
    low = (text or "").lower()
    found = ["".join(g) for g in _runs(low)]
    out = set()
    for i, w in enumerate(found):
        if w in anchors:
            content = [x for x in found[i + 1 :] if x not in anchors]
            if i + 1 < len(found) and found[i + 1] not in anchors:
                out.add(tuple(content[:chain]))
    return out


def _runs(text):
    own = []
    for c in text:
        if c.isalnum():
            own.append(c)
        elif own:
            yield own
            own = []
    if own:
        yield own

