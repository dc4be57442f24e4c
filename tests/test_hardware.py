import pytest

from shelfrank.functions import hardware as H


def test_cpu_score(evaluate):
    table = {
        "i9-14900HX": 10.0, "i5-1235U": 6.0, "i5-1340P": 6.5, "ryzen7": 5.0, "M2 Pro": 8.2, "Intel Ultra 7 258V": 7.0, None: 5.0,
        "Intel Ultra 7 155H": 7.0, "Ultra 7 155H": 8.0, "ultra7": 5.0, "core7": 5.0, "i7": 7.5, "Ryzen 7 7840HS": 8.2,
        "Ryzen 9 8945HX": 10.0, "i3": 4.0, "i5-1235-U": 5.0,
    }
    assert evaluate(H.cpu_score("a"), list(table)) == pytest.approx(list(table.values()))


def test_gpu_label(evaluate):
    table = {
        "rtx4060": "GeForce RTX 4060", "RTX 4070 Ti": "GeForce RTX 4070", "GTX 1660 Ti": "GeForce GTX 1660 TI",
        "AMD Radeon RX 7600": "Discrete GPU (Unknown)", "rx7600m": "Radeon RX 7600M", "Radeon 780M": "Radeon 780M (iGPU)",
        "apple integrated": "Integrated (generic)", "  ": "Integrated (generic)", None: "Integrated (generic)",
        "AMD RX 7600": "GPU (Unlabeled)", "rx680m": "Radeon RX 680M", "Intel Arc A770M": "Intel Arc A770M",
        "Apple M3 GPU": "Apple M3 GPU", "Radeon Vega 8": "Radeon Vega 8 (iGPU)", "intel uhd": "Intel UHD (iGPU)", "MX 450": "NVIDIA MX 450",
    }
    assert evaluate(H.gpu_label("a"), list(table)) == list(table.values())


def test_gpu_score(evaluate):
    table = {
        "GeForce RTX 4060": 8.0, "GeForce RTX 2060": 4.0, "Radeon RX 7600M": 4.0, "Radeon 780M (iGPU)": 3.5, "Apple M3 GPU": 8.0,
        "GPU (Unlabeled)": 2.0, None: 2.0, "rx 7600": 7.2, "rx 7600m": 7.0, "rx 7650": 7.1, "rx 5500": 5.5, "Radeon RX 7600": 4.0,
        "Intel Arc A770M": 7.5, "Intel Arc A310": 3.0, "GeForce GTX 1660 TI": 5.5, "NVIDIA MX 450": 3.6, "rtx 5055": 8.3,
        "Radeon 660M": 4.0, "m1": 7.0, "discrete": 4.0, "Intel UHD (iGPU)": 2.5,
    }
    assert evaluate(H.gpu_score("a"), list(table)) == pytest.approx(list(table.values()))


def test_cpu_suffix(evaluate):
    table = {
        "i9-14900HX": "hx", "i7-13620H": "h", "i5-1340P": "", "i5-1340-P": "p", "Ryzen 5 U": "u", "Ultra 7 258V": "p",
        "Ryzen 7 7840HS": "h", None: "", "hh": "h", "Core Ultra": "u",
    }
    got = evaluate(H.cpu_suffix("a"), list(table))
    assert got == list(table.values())


def test_flags(evaluate):
    labels = ["GeForce RTX 4060", "Apple M3 GPU", "GPU (Unlabeled)", "NVIDIA MX 450", "Intel UHD (iGPU)", "Integrated (generic)"]
    assert evaluate(H.has_dgpu("a"), labels) == [True, True, True, True, False, False]
    assert evaluate(H.has_cuda("a"), labels) == [True, False, False, False, False, False]
    assert evaluate(H.rtx_tier("a"), labels) == [4060, 0, 0, 0, 0, 0]
