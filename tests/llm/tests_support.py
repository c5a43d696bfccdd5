def repeated_bytes(docs, length):
    """docs: (id, bytes), sorted. -> flags of the bytes that a string of that length covers which also starts earlier."""
    seen, out = set(), []
    for _, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append(gone)
    return out
