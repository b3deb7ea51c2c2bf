"""A dense numpy version of the fit, written from the model's equations, to compare with."""

import math

import numpy as np


def psi(x):
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (x < 12).any():
        low = x < 12
        shift[low] -= 1.0 / x[low]
        x[low] += 1.0
    i = 1.0 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


lgam = np.vectorize(math.lgamma)


class Twin:
    def __init__(self, x, k, gamma, gam, correlated, alpha=20.0, beta=5.0):
        self.x, self.k, self.gamma, self.correlated = x, k, gamma, correlated
        m = len(x)
        self.gam = gam.copy()  # k x D
        self.a, self.b = np.full((m, k), 10.0), np.full((m, k), 10.0)
        self.mu, self.sig = np.zeros((m, k)), np.full((m, k), 1.0 if correlated else 0.0)
        self.u, self.cov = np.zeros(k), np.eye(k)
        self.v = 1.0 / np.arange(k, 0, -1)
        self.p = np.full(k, 1.0 / k)
        self.alpha, self.beta = alpha, beta

    def responsibilities(self):
        eln = psi(self.gam) - psi(self.gam.sum(1))[:, None]
        s = eln.T[None] + (psi(self.a) - np.log(self.b))[:, None, :]  # m x D x k
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def tokens_and_gamma(self):
        r = self.responsibilities()
        w = self.x[:, :, None] * r
        self.entropy = -(self.x[:, :, None] * np.where(r > 0, r * np.log(np.where(r > 0, r, 1)), 0)).sum()
        self.gam = self.gamma / self.x.shape[1] + w.sum(0).T
        self.n = w.sum(1)
        xi = (self.a / self.b).sum(1)
        self.a = self.n + self.beta * self.p
        self.b = (self.x.sum(1) / xi)[:, None] + np.exp(self.mu + self.sig / 2)

    def bound(self):
        d, k, g = self.x.shape[1], self.k, self.gamma
        eln = psi(self.gam) - psi(self.gam.sum(1))[:, None]
        elz = psi(self.a) - np.log(self.b)
        w, bp = self.a / self.b, self.beta * self.p
        total = ((self.gam - g / d) * eln).sum() + (self.n * elz).sum() + self.entropy
        total -= (self.x.sum(1) * np.log(w.sum(1))).sum()
        total += k * (math.lgamma(g) - d * math.lgamma(g / d)) + (g / d - 1) * eln.sum()
        total += lgam(self.gam).sum() - lgam(self.gam.sum(1)).sum() - ((self.gam - 1) * eln).sum()
        total += (bp * self.mu - lgam(bp) + (bp - 1) * elz - w * np.exp(self.mu + self.sig / 2)).sum()
        total += (self.a - np.log(self.b) + lgam(self.a) + (1 - self.a) * psi(self.a)).sum()
        total += (k - 1) * math.log(self.alpha) + (self.alpha - 1) * np.log(1 - self.v[:-1]).sum()
        if self.correlated:
            inv, off = np.linalg.inv(self.cov), self.mu - self.u
            total += -len(self.x) / 2 * np.linalg.slogdet(self.cov)[1] - 0.5 * (off @ inv * off).sum()
            total += -0.5 * (self.sig * np.diag(inv)).sum() + 0.5 * np.log(self.sig).sum() + len(self.x) * k / 2
        return total
