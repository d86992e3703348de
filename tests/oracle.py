"""A slow, independent LIKE: the set of places a pattern can have come to."""


def tokens(pattern, escape=None):
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if escape is not None and ch == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("trailing escape")
            out.append(("lit", pattern[i]))
        elif ch == "%":
            out.append(("any", ""))
        elif ch == "_":
            out.append(("one", ""))
        else:
            out.append(("lit", ch))
        i += 1
    return out


def matches(text, pattern, escape=None):
    places = {0}
    for kind, ch in tokens(pattern, escape):
        if kind == "any":
            places = set(range(min(places), len(text) + 1)) if places else set()
        elif kind == "one":
            places = {p + 1 for p in places if p < len(text)}
        else:
            places = {p + 1 for p in places if p < len(text) and text[p] == ch}
        if not places:
            return False
    return len(text) in places
