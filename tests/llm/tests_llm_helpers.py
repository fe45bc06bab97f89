"""Plain versions that tests share."""


def edit_table(pattern, text):
    """Least edit distance of the pattern to any stretch of the text, and its first end, by the full table."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i in range(1, len(pattern) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (pattern[i - 1] != c)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best
