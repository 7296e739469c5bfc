"""Fixed parameters shared by the registered queries and their independent SQL checks.

Weights come from one seeded formula; both sides receive the same literal numbers.
"""

from __future__ import annotations

import numpy as np


def fixed(shape, seed: int, scale: float = 0.5) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-scale, scale, size=shape)


# LI network [4, 3, 3]: weights with the bias in column 0
LI_SIZES = (4, 3, 3)


def li_weights():
    return [fixed((3, 5), 11, 1.0), fixed((3, 4), 12, 1.0)]


# plain dense layer / RBM on LI: W (3 x 4), c (3), b (4)
def li_layer():
    return fixed((3, 4), 21, 1.0), fixed((3,), 22, 0.5), fixed((4,), 23, 0.5)


EM_WIDTH = 64  # slots of an embedding; all of them are features


# dense layer on orders: 2 -> 3
def order_layer():
    return fixed((3, 2), 24, 1.0), fixed((3,), 25, 0.5)


# RBM on EM / EMB: all slots visible, 4 hidden
def em_rbm(n_hidden: int = 4):
    return fixed((n_hidden, EM_WIDTH), 31, 0.5), fixed((EM_WIDTH,), 32, 0.1), fixed((n_hidden,), 33, 0.1)


# DBN on EM: sizes [EM_WIDTH, 6, 4]
def em_dbn():
    return [(fixed((6, EM_WIDTH), 41, 0.5), fixed((EM_WIDTH,), 42, 0.1), fixed((6,), 43, 0.1)),
            (fixed((4, 6), 44, 0.5), fixed((6,), 45, 0.1), fixed((4,), 46, 0.1))]


# wide layer and network on EM: EM_WIDTH -> 80 (-> 10)
def em_wide():
    return fixed((80, EM_WIDTH), 71, 0.3), fixed((80,), 72, 0.3)


def em_wide_net():
    return [fixed((80, EM_WIDTH + 1), 73, 0.3), fixed((10, 81), 74, 0.3)]


def em_sigma():
    return 0.5 + np.abs(fixed((EM_WIDTH,), 47, 0.5))


# network on EM [EM_WIDTH, 6, 10]
EM_SIZES = (EM_WIDTH, 6, 10)


def em_weights():
    return [fixed((6, EM_WIDTH + 1), 51, 0.8), fixed((10, 7), 52, 0.8)]


# all features of the prepared well table (numbers and codes): network [WELL_WIDTH, 4, 3] and a Gaussian RBM of 4 hidden units
WELL_WIDTH = 120


def well_weights():
    return [fixed((4, WELL_WIDTH + 1), 81, 0.4), fixed((3, 5), 82, 0.8)]


def well_rbm():
    return fixed((4, WELL_WIDTH), 83, 0.3), fixed((WELL_WIDTH,), 84, 0.2), fixed((4,), 85, 0.2), 0.7 + np.abs(fixed((WELL_WIDTH,), 86, 0.4))
