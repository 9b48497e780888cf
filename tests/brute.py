"""Plain NumPy versions of the definitions, for small fleets."""

import numpy as np


def distances(cdfs, step=1.0):
    x = np.asarray(cdfs, dtype=float)
    return step * np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2)


def kmedoids(d, k, max_iter=300):
    """Rows must be in vin order. Returns labels, medoid positions and rounds."""
    d = np.round(d, 9)
    mean = np.round(d.mean(axis=1), 9)
    medoids = list(np.lexsort((np.arange(len(d)), mean))[:k])
    for done in range(1, max_iter + 1):
        labels = d[medoids].argmin(axis=0)
        new = []
        for q, current in enumerate(medoids):
            members = np.flatnonzero(labels == q)
            if not len(members):
                new.append(current)
                continue
            cost = np.round(d[np.ix_(members, members)].mean(axis=1), 9)
            best = members[cost.argmin()]
            stays = current in members and cost[list(members).index(current)] <= cost.min()
            new.append(current if stays else best)
        if new == medoids:
            break
        medoids = new
    return d[medoids].argmin(axis=0), medoids, done


def silhouettes(d, labels):
    out = np.zeros(len(d))
    codes = np.unique(labels)
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() == 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == q].mean() for q in codes if q != labels[i])
        out[i] = 0.0 if max(a, b) <= 1e-9 else (b - a) / max(a, b)
    return out
