"""Plain Python versions of the operators, for comparison."""

import collections
import hashlib
import re

import regex

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)
CUT = regex.compile(r"\n+|(?<=[^\p{L}\p{N}\s,])\s+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    """[(id, n_words, n_hit, items)] in the order of the documents."""
    windows = {}
    for name, text in items:
        words = ALNUM.findall(low(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(name)
    sizes = {len(w) for w in windows}
    found = []
    for key, text in docs:
        words = ALNUM.findall(low(text))
        hit, names = [0] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if here := windows.get(tuple(words[i : i + size])):
                    names |= here
                    hit[i : i + size] = [1] * size
        found.append((key, len(words), sum(hit), sorted(str(n) for n in names if n is not None)))
    return found


def shingles(text, words):
    found = NOT_SPACE.findall(low(text))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def components(docs, words, percent):
    """[(id, n_shingles, component id)]; null ids count as infinite."""
    sets = [shingles(t, words) for _, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: None)
    for i, (key, _) in enumerate(docs):
        r = root(i)
        if key is not None:
            least[r] = key if least[r] is None else min(least[r], key)
    return [(k, len(s), least[root(i)] if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True))]


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ["assign", "access", "hex"]
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(s[1] == k for s in spans) for k in range(3)] + [sha(listed)]


def repeats(texts, length):
    """[(n_bytes, n_removed, n_spans, kept)] of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    found = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(b), sum(gone), spans, kept))
    return found


def versions(docs):
    """{row: (id, n_chars, edited sha, near edited, near next)} for documents with distinct ids."""

    def parts(text):
        return {p[i : i + 256] for p in CUT.split(text) for i in range(0, len(p), 256)}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    ordered = sorted(((k, t or "") for k, t in docs), key=lambda d: (d[0] is not None, d[0]), reverse=True)
    found = []
    for i, (key, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = parts(text), parts(edited), parts(after)
        found.append((key, len(text), sha(edited), round(near(a, b), 9), round(near(a, c), 9)))
    return found


def count_phrases(rows):
    """{lang: counts of phrases of one to four words}, {lang: words} for rows (text, lang)."""
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, sizes


def collocations(rows, least, top):
    """[(lang, rank, phrase, a, l, r, n, score)] for rows (text, lang)."""
    counts, sizes = count_phrases(rows)
    found = []
    for lang, of in counts.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        absorbed = set()
        for longer, b in candidates.items():
            for m in range(2, len(longer)):
                inner = [longer[i : i + m] for i in range(len(longer) - m + 1)]
                absorbed.update(p for p in inner if 100 * b >= 80 * candidates[p])
        listed = []
        for p in candidates.keys() - absorbed:
            a = candidates[p]
            score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(found)


def alignment(docs, path_a, path_b):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    one.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(letters)))}
    held, found = collections.Counter(), []
    for key, text in docs:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in one.id_to_token(i))) for i in one.encode(whole.decode(), add_special_tokens=False).ids]
        b = []
        for i in other.encode(text or ""):
            piece = other.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(t for _, t in x) != whole for x in (a, b)):
            found.append((key, 0, 0, [], ""))
            continue
        groups, at = [([], [])], [0, 0]
        while a or b:
            side = 0 if a and (at[0] <= at[1] or not b) else 1
            token, piece = (a, b)[side].pop(0)
            groups[-1][side].append(token)
            at[side] += len(piece)
            if at[0] == at[1] and (a or b):
                groups.append(([], []))
        names = ";".join("|".join(",".join(map(str, half)) for half in g) for g in groups)
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(pairs))
        found.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), (len(groups), pairs), names))
    most = collections.Counter()
    for (x, _), count in held.items():
        most[x] = max(most[x], count)
    rows = []
    for key, n_a, n_b, of, names in found:
        n_groups, pairs = of or (0, [])
        best = sum(held[p] == most[p[0]] for p in pairs)
        rows.append((key, n_a, n_b, n_groups, len(pairs), best, sum(held[p] for p in pairs), names))
    return rows
