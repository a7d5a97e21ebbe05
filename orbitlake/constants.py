"""Physical constants; the digits are part of the contract."""

KB = 8.617333262145e-5  # eV/K, series and figures
KB_SCATTERING = 8.617333262e-5  # eV/K, structure factors
PLANCK = 4.135667696e-15  # eV s
CHARGE = 1.602176634e-19
AVOGADRO = 6.02214076e23
BAR_A3_TO_EV = 6.24150913e-7
AMU_A3_TO_G_CM3 = 1.66053906660
A2_PS_TO_CM2_S = 1e-4
A3_TO_CM3 = 1e-24
EV_A3_TO_GPA = 160.21766208
BOND_CUTOFF = 2.37  # Å
N_FRAMES, FRAME_SPACING_PS = 10, 5.0
PLATEAU_FRACTION = 0.20
OZ_KMAX = 0.8  # 1/Å
#: Femtoseconds in a time unit, by unit system.
TIME_UNIT_FS = {"real": 1.0, "electron": 1.0, "metal": 1e3, "si": 1e15, "cgs": 1e15}
#: Compositions at which fitted curves are marked.
GUIDE_X = (1 / 3, 1 / 2, 1 / 4, 6 / 29)
#: Energies and enthalpies (eV an atom) of the pure ends of the raw 1500 K tables, by pressure in GPa: (energy of A, of B, enthalpy of A, of B).
RAW_ENDPOINTS = {
    0: (-8.043070824, -6.434663479166667, -7.850557452, -6.2431970833333335),
    10: (-8.071581312000001, -6.442256819444444, -7.1645288680000005, -5.804338159722223),
}
