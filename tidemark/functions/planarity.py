"""Planarity of small graphs, by adding paths to faces (Demoucron, Malgrange, Pertuiset)."""

from __future__ import annotations


def _blocks(adjacent: dict) -> list[set]:
    """Edge sets of the biconnected components."""
    depth, low, out, stack = {}, {}, [], []
    for start in adjacent:
        if start in depth:
            continue
        depth[start] = low[start] = 0
        work = [(start, None, iter(adjacent[start]))]
        while work:
            v, parent, it = work[-1]
            for u in it:
                if u not in depth:
                    depth[u] = low[u] = depth[v] + 1
                    stack.append((v, u))
                    work.append((u, v, iter(adjacent[u])))
                    break
                if u != parent and depth[u] < depth[v]:
                    stack.append((v, u))
                    low[v] = min(low[v], depth[u])
            else:
                work.pop()
                if work:
                    p = work[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] >= depth[p]:
                        block = set()
                        while stack:
                            e = stack.pop()
                            block.add(frozenset(e))
                            if e == (p, v):
                                break
                        out.append(block)
    return out


def _cycle(adjacent: dict) -> list:
    start = next(iter(adjacent))
    parent, path = {start: None}, [start]
    work = [(start, iter(adjacent[start]))]
    while work:
        v, it = work[-1]
        for u in it:
            if u == parent[v]:
                continue
            if u in path:
                return path[path.index(u) :]
            parent[u] = v
            path.append(u)
            work.append((u, iter(adjacent[u])))
            break
        else:
            work.pop()
            path.pop()
    return []


def _block_planar(edges: set) -> bool:
    adjacent: dict = {}
    for a, b in map(tuple, edges):
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    n = len(adjacent)
    if n < 5 or len(edges) < 9:
        return True
    if len(edges) > 3 * n - 6:
        return False
    cycle = _cycle(adjacent)
    placed = set(cycle)
    done = {frozenset(e) for e in zip(cycle, cycle[1:] + cycle[:1], strict=True)}
    faces = [list(cycle), list(cycle)]
    while len(done) < len(edges):
        pieces: list[tuple[set, set, set]] = [(set(e), set(), {e}) for e in edges - done if e <= placed]  # contacts, inner vertices, edges
        seen: set = set()
        for v in adjacent:
            if v in placed or v in seen:
                continue
            inner, contacts, own, todo = {v}, set(), set(), [v]
            while todo:
                x = todo.pop()
                for u in adjacent[x]:
                    own.add(frozenset((x, u)))
                    if u in placed:
                        contacts.add(u)
                    elif u not in inner:
                        inner.add(u)
                        todo.append(u)
            seen |= inner
            pieces.append((contacts, inner, own))
        choice = None
        for contacts, inner, own in pieces:
            fit = [f for f in faces if contacts <= set(f)]
            if not fit:
                return False
            if choice is None or len(fit) == 1:
                choice = (contacts, inner, own, fit[0])
                if len(fit) == 1:
                    break
        contacts, inner, own, face = choice
        a = next(iter(contacts))
        back, todo, b = {a: None}, [a], None
        while todo and b is None:
            x = todo.pop(0)
            for u in adjacent[x]:
                if frozenset((x, u)) not in own or u in back or x == a and u in contacts and inner and frozenset((x, u)) in done:
                    continue
                if u in contacts and u != a:
                    back[u], b = x, u
                    break
                if u in inner:
                    back[u] = x
                    todo.append(u)
        path = [b]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        done |= {frozenset(e) for e in zip(path, path[1:], strict=False)}
        placed |= set(path)
        faces.remove(face)
        i, j = face.index(path[0]), face.index(path[-1])
        one = face[i : j + 1] if i <= j else face[i:] + face[: j + 1]
        two = face[j : i + 1] if j <= i else face[j:] + face[: i + 1]
        faces += [one + path[-2:0:-1], two + path[1:-1]]
    return True


def is_planar(edges: list[tuple]) -> bool:
    adjacent: dict = {}
    for a, b in edges:
        if a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    return all(_block_planar(b) for b in _blocks(adjacent))
