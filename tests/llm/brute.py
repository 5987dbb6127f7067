"""Plain versions of what the operators compute, for small inputs."""

import hashlib


def repeats(docs: dict[int, bytes], span: int = 100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i in sorted(docs):
        raw = docs[i]
        gone = bytearray(len(raw))
        for a in range(len(raw) - span + 1):
            s = raw[a : a + span]
            if s in seen:
                gone[a : a + span] = b"\1" * span
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs: dict, items: dict, size: int = 13):
    """doc_id -> (n_words, n_hit, item ids)."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    out = {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for item, item_text in items.items():
            v = words(item_text)
            k = min(size, len(v))
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), tuple(sorted(found)))
    return out


def near(docs: dict, k: int, percent: int = 80):
    """doc_id -> (set size, smallest id that links reach)."""
    sets = {}
    for i, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def gif_samples(media: bytes) -> list[bytes]:
    """Palette indices of each frame of a GIF without interlacing, code by code and bit by bit."""
    at = 13 + (3 << (media[10] & 7) + 1 if media[10] & 0x80 else 0)
    out = []
    while media[at] != 0x3B:
        if media[at] == 0x21:
            at += 2
            while media[at]:
                at += media[at] + 1
            at += 1
            continue
        flags = media[at + 9]
        at += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        size, at, stream = media[at], at + 1, b""
        while media[at]:
            stream, at = stream + media[at + 1 : at + 1 + media[at]], at + media[at] + 1
        at += 1
        bits = "".join(f"{b:08b}"[::-1] for b in stream)
        clear, place, samples, table, width, before = 1 << size, 0, b"", [], size + 1, None
        while True:
            code, place = int(bits[place : place + width][::-1], 2), place + width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
                continue
            if code == clear + 1:
                break
            text = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + text[:1])
            samples, before = samples + text, text
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append(samples)
    return out


def log_probability(model, words, tail, text_tokens) -> float:
    """log P of one text's word hashes by the language model's weights, token by token."""
    import numpy as np

    place = {int(w): i for i, w in enumerate(model.order)}
    wide, tails, end = 32, 2, text_tokens[-1]
    kind = lambda w: int(model.kind[place[w]]) if w in place else wide - tails + (w >> 40) % tails
    total = 0.0
    for i, w in enumerate(text_tokens):
        back = [text_tokens[i - n] if i >= n else end for n in (1, 2, 3)]
        c = [kind(b) for b in back]
        rows = [model._row(np.array([x], np.uint64), f)[0] for f, x in enumerate((back[0], back[1], c[0] << 8 | c[1], c[1] << 8 | c[2]))]
        z = sum(model.weights[r].astype(float) for r in rows) + model.weights[1 << model.bits]
        total += z[kind(w)] - np.log(np.exp(z).sum())
        if w in place:
            own = kind(w) * 0xD6E8FEB86659FD93
            rows = [model._row(np.array([(x + own) % 2**64], np.uint64), f)[0] for f, x in ((4, back[0]), (5, back[1]))]
            z = sum(model.weights[r].astype(float) for r in rows) + model.weights[(1 << model.bits) + 1 + kind(w)]
            total += z[model.sub[place[w]]] - np.log(np.exp(z).sum()) + model.inside[place[w]]
        else:
            t = (w >> 40) % tails
            count, known = words.get(w, (0, {}))
            total += known[c[0]] if c[0] in known else np.log((count + 0.5) / tail.size[t] / tail.norms[-1][t * wide + c[0]])
    return total


def conversations(rows: list[tuple]) -> dict:
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of damaged conversations, by a table of states."""
    import zlib

    spaces, talks = " \t\n\x0b\x0c\r", {}
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        talks.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, seen, faults = [0, 0, 0], set(), []
        for _, role, text in talk:
            bare = text.strip(spaces)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            faults.append(fault)
            if fault < 3:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))

        def insert(states):
            for _ in range(4):
                for s, (cost, audit, lines) in list(states.items()):
                    r = "a" if s == "u" else "u"
                    x = cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[r])
                    states[r] = min(states.get(r, x), x)
            return states

        states = {"": (0, "", ())}
        for (_, role, text), fault in zip(talk, faults):
            after = {}
            for s, (cost, audit, lines) in insert(states).items():
                ways = [(s, (cost + 3, audit + "D", lines))]
                if fault > 1:
                    if (s, role[:1]) in follow:
                        ways.append((role[:1], (cost + (fault == 2), audit + "K", (*lines, f"{role}:{text}"))))
                    r = "a" if s == "u" else "u"
                    ways.append((r, (cost + 2 + (fault == 2), audit + "R", (*lines, f"{'user' if r == 'u' else 'assistant'}:{text}"))))
                for to, way in ways:
                    after[to] = min(after.get(to, way), way)
            states = after
        cost, audit, lines = min(v for s, v in insert(states).items() if s in ("", "a"))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
