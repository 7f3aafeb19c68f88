"""Plain versions of the ordering steps on Python sets, for the tests to compare with."""


def break_cycles(nodes, edges, years):
    """(edges kept, edges dropped): a depth-first walk from the oldest drops what leads back to a node still open."""
    dated = sorted(y for y in (years.get(n) for n in nodes) if y is not None)
    middle = dated[len(dated) // 2] if dated else 0
    open_, done, dropped = [], set(), set()

    def visit(n):
        open_.append(n)
        for a, b in sorted(edges):
            if a == n and b in open_:
                dropped.add((a, b))
            elif a == n and b not in done:
                visit(b)
        open_.pop()
        done.add(n)

    for n in sorted(nodes, key=lambda n: (middle if years.get(n) is None else years[n], n)):
        if n not in done:
            visit(n)
    return edges - dropped, dropped


def levels(nodes, edges):
    """Longest ways, by going over all edges until nothing changes."""
    out = dict.fromkeys(nodes, 0)
    while True:
        longer = {b: out[a] + 1 for a, b in edges if out[b] < out[a] + 1}
        if not longer:
            return out
        out |= longer


def reduce_transitively(edges):
    """Edges without those whose target is reached by another successor of their source."""
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return {(a, b) for a, b in edges if not any((c, b) in reach for x, c in edges if x == a and c != b)}
        reach |= more
