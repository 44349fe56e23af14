"""Searches of many requests at once over one graph in flat arrays.

All requests of a lot advance together, a round at a time: of each search the labels near its least
one are settled, their neighbours get labels, and searches from both ends meet. Labels of all searches
lie in common arrays, found by a hash table, so a round is a few operations on whole arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

BUDGET = 5_000_000
FOUND, NONE, STOPPED = 0, 1, 2
FAR = 1 << 61
#: Searches that advance together.
WIDTH = 2048
#: A side that has so many times the open labels of the other waits for it.
LEAD = 4


def at_ends(places: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows, and which position, for every position from first up to last of each."""
    n = last - first
    row = np.repeat(places, n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Graph:
    """Arcs laid out by node, both ways. Arcs go by their place in the order of source and id."""

    names: np.ndarray
    arc: np.ndarray
    link: np.ndarray
    links: np.ndarray
    group: np.ndarray
    groups: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    cost: np.ndarray
    out_at: np.ndarray
    into_at: np.ndarray
    into: np.ndarray
    banned: np.ndarray
    bans: np.ndarray
    long_bans: list[list[int]]
    step: int
    #: Further columns of arcs (by place) and of nodes.
    more: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def lay_out(arc: np.ndarray, link: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray, group: np.ndarray, bans: list[list[int]] | None = None, more: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], object]:
        """The arrays, each as narrow as it can be, and what is beside them."""
        small = lambda x: x.astype(np.int32) if not len(x) or (x.max() < 2**31 and x.min() >= -(2**31)) else x.astype(np.int64)
        names = np.unique(np.concatenate([source, target])).astype(np.int64)
        s, t = small(np.searchsorted(names, source)), small(np.searchsorted(names, target))
        order = np.lexsort((arc, s))
        s, t = s[order], t[order]
        links, link = np.unique(link, return_inverse=True)
        groups, group = np.unique(group, return_inverse=True)
        count = lambda x: small(np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(names))))))
        pairs = np.array([b for b in bans or [] if len(b) == 2], np.int64).reshape(-1, 2)
        known = np.isin(pairs, links).all(axis=1) if len(links) else np.zeros(len(pairs), bool)
        a, b = np.searchsorted(links, pairs[known].T)
        link = small(link)[order]
        arrays = {"names": names, "arc": arc[order], "link": link, "links": links.astype(np.int64), "group": small(group)[order], "groups": groups.astype(np.int64), "tail": s, "head": t, "cost": small(cost)[order], "out_at": count(s), "into_at": count(t)}
        arrays |= {"into": small(np.argsort(t, kind="stable")), "banned": np.isin(link, a), "bans": np.unique(a.astype(np.int64) * len(links) + b)}
        arrays |= {f"more {k}": x[order] for k, x in (more or {}).items()}
        return arrays, ([b for b in bans or [] if len(b) > 2], int(max(1, np.median(cost))) if len(cost) else 1)

    @staticmethod
    def of(arrays: dict[str, np.ndarray], rest: object) -> Graph:
        more = {k.removeprefix("more "): x for k, x in arrays.items() if k.startswith("more ")}
        return Graph(**{k: x for k, x in arrays.items() if not k.startswith("more ")}, long_bans=rest[0], step=rest[1], more=more)

    def _place(self, known: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[at] == x, at, -1)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Nodes by number; -1 for one that no arc meets."""
        return self._place(self.names, x)

    def group_of(self, x: np.ndarray) -> np.ndarray:
        return self._place(self.groups, x)

    def turn(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether one arc may follow another: no banned turn, no turning back on a link."""
        a, b = self.link[first], self.link[second]
        ok = a != b
        ask = np.flatnonzero(ok & self.banned[first])
        if len(ask) and len(self.bans):
            key = a[ask].astype(np.int64) * len(self.links) + b[ask]
            ok[ask] = self.bans[np.minimum(np.searchsorted(self.bans, key), len(self.bans) - 1)] != key
        return ok

    def banned_turn(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ~self.turn(first, second) & (self.link[first] != self.link[second])

    def links_of(self, path: np.ndarray) -> np.ndarray:
        """Links in the order passed, each once in a row."""
        l = self.links[self.link[path]]
        return l[np.concatenate(([True], l[1:] != l[:-1]))] if len(l) else l

    def forbidden(self, links: list[int]) -> bool:
        """Whether a way makes a ban of more than two links."""
        return any(links[i : i + len(b)] == b for b in self.long_bans for i in range(len(links) - len(b) + 1))

    # --- trees -------------------------------------------------------------------------------------
    def tree(self, start: int, targets: np.ndarray | None = None, turns: bool = False, budget: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
        """Status, costs (FAR where there is none) and the arc each is reached by (of equally good
        ones the least id), from one source: of all nodes, or until the targets are settled. With
        turns, from an arc to arcs, by permitted turns."""
        n = len(self.arc if turns else self.names)
        dist, via, waits = np.full(n, FAR), np.full(n, -1, np.int32 if n < 2**31 else np.int64), np.zeros(n, bool)
        dist[start] = 0
        open_, settled, rounds = np.array([start]), 0, 0
        while len(open_):
            d = dist[open_]
            least = d.min()
            if targets is not None and rounds % 16 == 0 and dist[targets].max() <= least:
                break
            rounds += 1
            now = d <= least + self.step // 2
            at, open_ = open_[now], open_[~now]
            waits[at] = False
            settled += len(at)
            if budget is not None and settled > budget:
                return STOPPED, dist, via
            node = self.head[at] if turns else at
            row, k = at_ends(np.arange(len(at)), self.out_at[node].astype(np.int64), self.out_at[node + 1].astype(np.int64))
            if turns:
                ok = self.turn(at[row], k)
                row, k = row[ok], k[ok]
            to = k if turns else self.head[k]
            new = dist[at[row]] + self.cost[k]
            better = new < dist[to]
            to, new, how = to[better], new[better], (at[row] if turns else k)[better]
            np.minimum.at(dist, to, new)
            won = dist[to] == new
            to = to[won]
            via[to] = how[won]
            to = np.unique(to)
            to = to[~waits[to]]
            waits[to] = True
            open_ = np.concatenate([open_, to])
        if not turns:
            # written from the greatest id down, the least is written last
            by_id = np.argsort(self.arc, kind="stable")[::-1]
            for part in np.array_split(by_id, max(1, len(by_id) >> 20)):
                a, b = dist[self.tail[part]], dist[self.head[part]]
                part = part[(a < b) & (a + self.cost[part] == b) & (b < FAR)]
                via[self.head[part]] = part
        return FOUND, dist, via

    def fold(self, via: np.ndarray, values: np.ndarray, add: Callable = np.add) -> np.ndarray:
        """The values of all nodes on the way to each node of a tree as one; that of a root must not
        change what is added to it. Ways double in length with each round."""
        up = np.where(via >= 0, self.tail[via], np.arange(len(via))) if len(via) else via
        while len(up):
            values, on = add(values, values[up]), up[up]
            if (on == up).all():
                break
            up = on
        return values

    def levels(self, via: np.ndarray) -> np.ndarray:
        """How many arcs lead to each node of a tree."""
        return self.fold(via, (via >= 0).astype(np.int64))

    def before(self, via: np.ndarray) -> np.ndarray:
        """The arc before the last one to each node of a tree, -1 where there is none."""
        return np.where(via >= 0, via[self.tail[via]], -1)

    def groups_passed(self, start: int, via: np.ndarray) -> np.ndarray:
        """How many groups the way to each node of a tree has: a walk down the tree that counts what
        lies above it."""
        n = len(via)
        inner = np.flatnonzero(via >= 0)
        up = self.tail[via[inner]]
        order = np.argsort(up, kind="stable")
        kids = memoryview(np.ascontiguousarray(inner[order], np.int64))
        at = memoryview(np.concatenate(([0], np.cumsum(np.bincount(up, minlength=n)))).astype(np.int64))
        own = memoryview(np.where(via >= 0, self.group[via], 0).astype(np.int64))
        out = np.zeros(n, np.int64)
        got, over = memoryview(out), memoryview(np.zeros(len(self.groups) + 1, np.int64))
        next_, stack, now = memoryview(np.array(at[:n])), [start], 0
        while stack:
            x = stack[-1]
            k = next_[x]
            if k < at[x + 1]:
                next_[x] = k + 1
                y = kids[k]
                g = own[y]
                if not over[g]:
                    now += 1
                over[g] += 1
                got[y] = now
                stack.append(y)
            else:
                stack.pop()
                if x != start:
                    g = own[x]
                    over[g] -= 1
                    if not over[g]:
                        now -= 1
        return out

    def paths(self, via: np.ndarray, deep: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and places of the arcs that lead to each of the nodes."""
        ends = np.concatenate(([0], np.cumsum(deep[to])))
        out, at, now = np.empty(ends[-1], np.int64), ends[1:] - 1, to
        while True:
            on = via[now] >= 0
            if not on.all():
                at, now = at[on], now[on]
            if not len(now):
                return ends, out
            k = via[now]
            out[at] = k
            at, now = at - 1, self.tail[k]

    def reached(self, start: int) -> np.ndarray:
        """Nodes that a start reaches, in order."""
        seen = np.zeros(len(self.names), bool)
        seen[start] = True
        at = np.array([start])
        while len(at):
            _, k = at_ends(at, self.out_at[at].astype(np.int64), self.out_at[at + 1].astype(np.int64))
            to = self.head[k]
            at = np.unique(to[~seen[to]])
            seen[at] = True
        return np.flatnonzero(seen)


class _Labels:
    """Labels of all searches: key (search and side, state), cost, the arc and the label before, and
    whether its neighbours are still to be met."""

    _KINDS = {"key": np.int64, "dist": np.int64, "via": np.int64, "before": np.int64, "waits": bool}

    def __init__(self, states: int) -> None:
        self.states, self.n = states, 0
        self._sized(1 << 14)

    def _sized(self, room: int) -> None:
        for name, kind in self._KINDS.items():
            new = np.empty(room, kind)
            if self.n:
                new[: self.n] = getattr(self, name)[: self.n]
            setattr(self, name, new)
        self.room, self.bits = room, (2 * room - 1).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self._enter(np.arange(self.n))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _enter(self, labels: np.ndarray) -> None:
        h, mask = self._hash(self.key[labels]), (1 << self.bits) - 1
        while len(labels):
            free = self.slots[h] < 0
            self.slots[h[free]] = labels[free]
            left = self.slots[h] != labels
            labels, h = labels[left], (h[left] + 1) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Labels by key, -1 where there is none."""
        out, left, h, mask = np.full(len(keys), -1), np.arange(len(keys)), self._hash(keys), (1 << self.bits) - 1
        while len(left):
            i = self.slots[h]
            used = i >= 0
            hit = used & (self.key[i] == keys[left])
            out[left[hit]] = i[hit]
            on = used & ~hit
            left, h = left[on], (h[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> int:
        """Labels for new keys, each given once, without a cost yet; the first of them."""
        first, self.n = self.n, self.n + len(keys)
        if self.n > self.room:
            self.n = first
            self._sized(1 << (2 * (first + len(keys))).bit_length())
            self.n = first + len(keys)
        new = slice(first, self.n)
        self.key[new], self.dist[new], self.via[new], self.before[new], self.waits[new] = keys, FAR, -1, -1, False
        self._enter(np.arange(first, self.n))
        return first

    def keep(self, mask: np.ndarray) -> np.ndarray:
        """Drops all other labels; the new number of each."""
        new = np.cumsum(mask) - 1
        old = np.flatnonzero(mask)
        for name in self._KINDS:
            getattr(self, name)[: len(old)] = getattr(self, name)[old]
        self.n = len(old)
        up = self.before[: self.n]
        self.before[: self.n] = np.where(up >= 0, new[up], -1)
        self.slots[:] = -1
        self._enter(np.arange(self.n))
        return new


class _Lot:
    def __init__(self, g: Graph, turns: bool, budget: int, width: int) -> None:
        self.g, self.turns, self.budget = g, turns, budget
        self.labels = _Labels(len(g.arc) if turns else len(g.names))
        self.of, self.ban, self.goal = np.full(width, -1), np.full(width, -1), np.full(width, FAR * 2)
        self.visited, self.meet = np.zeros(width, np.int64), np.full((width, 2), -1)
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.open = np.empty(0, np.int64)

    def _offer(self, keys: np.ndarray, dist: np.ndarray, via: np.ndarray, before: np.ndarray) -> None:
        """Labels of these costs, where they are better, and what they meet."""
        t, s = self.labels, self.labels.states
        at = t.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, which = np.unique(keys[new], return_inverse=True)
            at[new] = t.add(fresh) + which
        better = dist < t.dist[at]
        at, dist, via, before = at[better], dist[better], via[better], before[better]
        np.minimum.at(t.dist, at, dist)
        won = t.dist[at] == dist
        at = at[won]
        t.via[at], t.before[at] = via[won], before[won]
        at = np.unique(at)
        fresh = at[~t.waits[at]]
        t.waits[fresh] = True
        self.open = np.concatenate([self.open, fresh])
        side = t.key[at] // s
        other = t.find(t.key[at] + np.where(side % 2 == 0, s, -s))
        met = np.flatnonzero(other >= 0)
        at, other, slot, back = at[met], other[met], side[met] // 2, side[met] % 2 == 1
        total = t.dist[at] + t.dist[other]
        np.minimum.at(self.goal, slot, total)
        best = self.goal[slot] == total
        self.meet[slot[best], 0] = np.where(back, other, at)[best]
        self.meet[slot[best], 1] = np.where(back, at, other)[best]

    def start(self, ids: np.ndarray, s: np.ndarray, t: np.ndarray, ban: np.ndarray) -> None:
        """Puts requests into free slots."""
        g, n = self.g, self.labels.states
        slot = np.flatnonzero(self.of < 0)[: len(ids)]
        self.of[slot], self.ban[slot], self.goal[slot], self.visited[slot], self.meet[slot] = ids, ban, FAR * 2, 0, -1
        none = lambda x: np.full(len(x), -1)
        if not self.turns:
            keys = np.concatenate([2 * slot * n + s, (2 * slot + 1) * n + t])
            self._offer(keys, np.zeros(len(keys), np.int64), none(keys), none(keys))
            return
        row, k = at_ends(np.arange(len(ids)), g.out_at[s].astype(np.int64), g.out_at[s + 1].astype(np.int64))
        ok = g.group[k] != ban[row]
        row, k = row[ok], k[ok]
        back, j = at_ends(np.arange(len(ids)), g.into_at[t].astype(np.int64), g.into_at[t + 1].astype(np.int64))
        j = g.into[j]
        ok = g.group[j] != ban[back]
        back, j = back[ok], j[ok]
        keys = np.concatenate([2 * slot[row] * n + k, (2 * slot[back] + 1) * n + j])
        self._offer(keys, np.concatenate([g.cost[k].astype(np.int64), np.zeros(len(j), np.int64)]), none(keys), none(keys))

    def step(self) -> None:
        """One round of every search."""
        g, t, n = self.g, self.labels, self.labels.states
        width = len(self.of)
        side, state = np.divmod(t.key[self.open], n)
        d = t.dist[self.open]
        many = np.bincount(side, minlength=2 * width)
        least = np.full(2 * width, FAR)
        np.minimum.at(least, side, d)
        a, b = least[0::2], least[1::2]
        over = (self.of >= 0) & ((a >= FAR) | (b >= FAR) | (a + b >= self.goal))
        slot = side // 2
        # what lies beyond can be no part of a better way
        on = (d + least[side ^ 1] < self.goal[slot]) & ~over[slot]
        now = on & (many[side] <= LEAD * many[side ^ 1]) & (d <= least[side] + 2 * g.step)
        self.visited += np.bincount(slot[now], minlength=width)
        late = (self.of >= 0) & ~over & (self.visited > self.budget)
        if over.any() or late.any():
            self._finish(np.flatnonzero(over), np.flatnonzero(late))
            on &= ~late[slot]
            now &= on
        label = self.open[now]
        left = on & ~now
        # also of those left out: they may get better
        t.waits[self.open[~left]] = False
        self.open = self.open[left]
        side, state, d, slot = side[now], state[now], d[now], slot[now]
        ahead = side % 2 == 0
        node = state
        if self.turns:
            node = np.where(ahead, g.head[state], g.tail[state])
        first = np.where(ahead, g.out_at[node], g.into_at[node]).astype(np.int64)
        last = np.where(ahead, g.out_at[node + 1], g.into_at[node + 1]).astype(np.int64)
        row, k = at_ends(np.arange(len(label)), first, last)
        forth = ahead[row]
        back = np.flatnonzero(~forth)
        k[back] = g.into[k[back]]
        ok = g.group[k] != self.ban[slot[row]]
        if self.turns:
            own = state[row]
            ok &= g.turn(np.where(forth, own, k), np.where(forth, k, own))
            to, cost = k, g.cost[np.where(forth, k, own)]
        else:
            to, cost = np.where(forth, g.head[k], g.tail[k]), g.cost[k]
        dist = d[row] + cost
        ok &= dist < self.goal[slot[row]]
        row, to, dist, k = row[ok], to[ok], dist[ok], k[ok]
        self._offer(side[row] * n + to, dist, k, label[row])

    def _finish(self, over: np.ndarray, late: np.ndarray) -> None:
        for slot, how in ((over, np.where(self.goal[over] < FAR, FOUND, NONE)), (late, np.full(len(late), STOPPED))):
            self.done.append((slot, self.of[slot], how))
            # until the labels are swept, a slot is not free
            self.of[slot] = -2

    def sweep(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of searches that ended: ids, status, cost, and their ways as offsets and places. Frees
        their slots and labels."""
        for slot, ids, how in self.done:
            ends, places = self._ways(slot[how == FOUND])
            n = np.zeros(len(ids), np.int64)
            n[how == FOUND] = np.diff(ends)
            yield ids, how, np.where(how == FOUND, self.goal[slot], -1), np.concatenate(([0], np.cumsum(n))), places
        self.done = []
        self.of[self.of == -2] = -1
        new = self.labels.keep(self.of[self.labels.key[: self.labels.n] // self.labels.states // 2] >= 0)
        self.open = new[self.open]
        held = self.of >= 0
        self.meet[held] = np.where(self.meet[held] >= 0, new[self.meet[held]], -1)

    def _ways(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, pieces = self.labels, []
        for side, sign in ((0, -1), (1, 1)):
            label = self.meet[slot, side]
            if self.turns and side == 1:
                # the arc where they met counts once
                label = t.before[label]
            who, k = np.arange(len(slot)), 0
            while True:
                on = label >= 0
                if not self.turns:
                    on &= t.via[label] >= 0
                who, label = who[on], label[on]
                if not len(who):
                    break
                k += 1
                pieces.append((who, np.full(len(who), sign * k), t.key[label] % t.states if self.turns else t.via[label]))
                label = t.before[label]
        if not pieces:
            return np.zeros(len(slot) + 1, np.int64), np.empty(0, np.int64)
        who, at, place = (np.concatenate(x) for x in zip(*pieces, strict=True))
        return np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(slot))))), place[np.lexsort((at, who))]


def search(g: Graph, s: np.ndarray, t: np.ndarray, ban: np.ndarray, turns: bool = False, budget: int = BUDGET, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Status, cost, and offsets and places of the arcs of a cheapest way from each node of s to that
    of t without arcs of a group; with turns, by permitted turns only. -1 is a node that no arc meets."""
    status, cost = np.full(len(s), NONE), np.full(len(s), -1)
    met = (s >= 0) & (t >= 0)
    same = met & (s == t)
    status[same], cost[same] = FOUND, 0
    todo = np.flatnonzero(met & ~same)
    width = max(1, min(width, len(todo)))
    lot, at, ways = _Lot(g, turns, budget, width), 0, []
    while True:
        busy = int((lot.of >= 0).sum())
        if busy * 2 <= width and at < len(todo) or not busy:
            for ids, how, c, ends, places in lot.sweep():
                status[ids], cost[ids] = how, c
                ways.append((ids, ends, places))
            ids = todo[at : at + width - busy]
            at += len(ids)
            if len(ids):
                lot.start(ids, s[ids], t[ids], ban[ids])
            elif not busy:
                break
        lot.step()
    n = np.zeros(len(s), np.int64)
    for ids, ends, _ in ways:
        n[ids] = np.diff(ends)
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(offsets[-1], np.int64)
    for ids, _, places in ways:
        _, to = at_ends(ids, offsets[ids], offsets[ids + 1])
        out[to] = places
    return status, cost, offsets, out


def routes(g: Graph, s: np.ndarray, t: np.ndarray, ban: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with banned turns: a plain way that makes one is searched again by permitted turns.
    Also whether it was, and whether it still makes a ban of more than two links, which has no turn
    to leave out."""
    status, cost, ends, path = search(g, s, t, ban, False, budget)
    again, unsound = np.zeros(len(s), bool), np.zeros(len(s), bool)
    if not len(g.bans) and not g.long_bans:
        return status, cost, ends, path, again, unsound
    who = np.repeat(np.arange(len(s)), np.diff(ends))
    pair = np.flatnonzero(who[1:] == who[:-1])
    again[who[pair][g.banned_turn(path[pair], path[pair + 1])]] = True
    if g.long_bans:
        again |= _forbidden(g, ends, path)
    ask = np.flatnonzero(again)
    if len(ask):
        st, c, e, p = search(g, s[ask], t[ask], ban[ask], True, budget)
        status[ask], cost[ask] = st, c
        n = np.diff(ends)
        n[ask] = np.diff(e)
        offsets = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(offsets[-1], np.int64)
        held = np.flatnonzero(~again)
        out[at_ends(held, offsets[held], offsets[held + 1])[1]] = path[at_ends(held, ends[held], ends[held + 1])[1]]
        out[at_ends(ask, offsets[ask], offsets[ask + 1])[1]] = p
        ends, path = offsets, out
        if g.long_bans:
            unsound = again & (status == FOUND) & _forbidden(g, ends, path)
    return status, cost, ends, path, again, unsound


def _forbidden(g: Graph, ends: np.ndarray, path: np.ndarray) -> np.ndarray:
    return np.array([g.forbidden(g.links_of(path[a:b]).tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], bool)
