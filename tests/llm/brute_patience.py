"""Patience diff written again, plainly and recursively, to hold the operator's against."""

from collections import Counter


def rising(pairs):
    """Longest chain with ascending second numbers; of equals the latest, back from the end."""
    size = []
    for k, (_, b) in enumerate(pairs):
        size.append(1 + max([size[j] for j in range(k) if pairs[j][1] < b], default=0))
    out, want, k = [], max(size, default=0), len(pairs)
    while want:
        k = max(j for j in range(k) if size[j] == want)
        out.append(pairs[k])
        want -= 1
    return out[::-1]


def matches(a, b):
    out = set()

    def go(al, ah, bl, bh):
        while al < ah and bl < bh and a[al] == b[bl]:
            out.add((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.add((ah, bh))
        if al == ah or bl == bh:
            return
        mine, yours = Counter(a[al:ah]), Counter(b[bl:bh])
        pairs = [(i, bl + b[bl:bh].index(a[i])) for i in range(al, ah) if mine[a[i]] == yours[a[i]] == 1]
        if not pairs:
            nth = lambda x, lo, k: (x[k], x[lo:k].count(x[k]))
            where = {nth(b, bl, j): j for j in range(bl, bh)}
            pairs = [(i, where[nth(a, al, i)]) for i in range(al, ah) if nth(a, al, i) in where]
        chain = rising(pairs)
        if chain:
            go(al, chain[0][0], bl, chain[0][1])
        for (i, j), (i2, j2) in zip(chain, [*chain[1:], (ah, bh)]):
            out.add((i, j))
            go(i + 1, i2, j + 1, j2)

    go(0, len(a), 0, len(b))
    return sorted(out)


def deleted(earlier, later, evidence, run):
    """Lines of the later text in deleted blocks."""
    out, block = [], []
    for m in [*matches(earlier, later), (-9, -9)]:
        if block and m != (block[-1][0] + 1, block[-1][1] + 1):
            lines = [j for _, j in block]
            if len(lines) >= run or len(lines) == len(later) or any(evidence[j] for j in lines):
                out += lines
            block = []
        block.append(m)
    return out
