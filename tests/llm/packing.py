"""Packing whole groups on one machine: what sharding's result is held against."""

from bisect import bisect_left
from collections import Counter


def pack(sizes: dict[int, int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Seats of groups, of which ``sizes`` holds the number by size: (size, first, end, shard, n), n rows of the groups first to end - 1.

    The largest groups come first, each size where there is room; a group larger than a quota fills shards that are empty. Where
    a group fits nowhere, shards exchange a group for a smaller one (or give one away) until it fits; only if no exchange makes
    it fit is it split, over as few shards as can be. There are at most sqrt(2 * rows) sizes.
    """
    room = list(quotas)
    held = [Counter() for _ in quotas]  # whole groups by size, and rests of groups larger than a quota
    big: list[list] = []  # [size, {shard: n}, rest] of a group that no shard holds
    most = max(quotas, default=0)
    for size in sorted((s for s in sizes if s > most), reverse=True):
        for _ in range(sizes[size]):
            parts: dict[int, int] = {}
            rest = size
            for j in sorted(range(len(room)), key=lambda j: -room[j]):
                if rest > most and room[j] == quotas[j] > 0:
                    parts[j] = room[j]
                    rest -= room[j]
                    room[j] = 0
            big.append([size, parts, rest])
    todo = Counter({s: n for s, n in sizes.items() if s <= most}) + Counter(rest for _, _, rest in big if rest)
    left: list[int] = []
    for size in sorted(todo, reverse=True):
        n = todo[size]
        for j in sorted(range(len(room)), key=lambda j: room[j]):
            if fit := min(n, room[j] // size):
                held[j][size] += fit
                room[j] -= fit * size
                n -= fit
        left += [size] * n

    def exchanged(need: int) -> bool:
        """Places a group of ``need`` rows by an exchange between two shards."""
        order = [sorted(+h) for h in held]
        for i in sorted(range(len(room)), key=lambda i: -room[i]):
            least = need - room[i]
            for j in range(len(room)):
                if j == i or room[j] < least:
                    continue
                for s in order[i]:
                    if s < least:
                        continue
                    if s <= room[j]:
                        back = 0
                    else:
                        k = bisect_left(order[j], s - room[j])
                        if k == len(order[j]) or order[j][k] > s - least:
                            continue
                        back = order[j][k]
                    held[i][s] -= 1
                    held[j][s] += 1
                    if back:
                        held[j][back] -= 1
                        held[i][back] += 1
                    held[i][need] += 1
                    room[i] += s - back - need
                    room[j] -= s - back
                    return True
        return False

    split: list[tuple[int, dict[int, int]]] = []
    for size in left:
        if (j := next((j for j in range(len(room)) if room[j] >= size), None)) is not None:
            held[j][size] += 1
            room[j] -= size
        elif not exchanged(size):
            parts, rest = {}, size
            for j in sorted(range(len(room)), key=lambda j: -room[j]):
                if n := min(rest, room[j]):
                    parts[j] = n
                    rest -= n
                    room[j] -= n
            split.append((size, parts))
    for group in big:  # their rests are groups of their size like others, so any of these will do
        rest = group[2]
        if rest:
            j = next((j for j in range(len(held)) if held[j][rest] > 0), None)
            if j is not None:
                held[j][rest] -= 1
                more = {j: rest}
            else:
                k = next(k for k, (size, _) in enumerate(split) if size == rest)
                more = split.pop(k)[1]
            for j, n in more.items():
                group[1][j] = group[1].get(j, 0) + n
    seats = []
    at: Counter = Counter()
    for j, h in enumerate(held):
        for size, n in sorted((+h).items()):
            seats.append((size, at[size], at[size] + n, j, size))
            at[size] += n
    for size, parts in [*split, *((size, parts) for size, parts, _ in big)]:
        seats += [(size, at[size], at[size] + 1, j, n) for j, n in parts.items()]
        at[size] += 1
    return seats
