"""Inputs and expected values that any implementation of the semantics must reproduce."""

#: One variable x on an irregular time step.
SCALAR = """0:0 0.3947:0.5881 0.7587:1.1068 1.066:1.4967 1.2998:1.7169 1.4546:1.7508 1.5377:1.6075 1.5675:1.3204
1.5708:0.9412 1.5787:0.5313 1.6216:0.1525 1.7242:-0.1431 1.9019:-0.3207 2.1583:-0.368 2.4844:-0.2963 2.8603:-0.1383
3.2583:0.0582 3.6471:0.2386 3.9968:0.3511 4.284:0.3561 4.4947:0.2326 4.6273:-0.017 4.6925:-0.3667 4.7114:-0.7708
4.7128:-1.1705 4.728:-1.5029 4.7861:-1.7113 4.9095:-1.7537 5.1104:-1.6104 5.3886:-1.2874 5.7317:-0.816"""

#: time:x@mode
HYBRID = """1:23@2 2:21@2 3:18@3 4:16@3 5:12@3 6:7@1 7:4@2 8:2@4 9:1@3 10:1@1
11:1@1 12:1@1 13:23@1 14:34@1 15:4@2 16:2@2 17:3@2 18:4@3 19:25@3 20:23@4
21:25@4 22:2@4 23:34@4 24:23@1 25:43@1 26:34@1 27:34@1 28:34@3 29:34@3 30:45@3
31:5@3 32:5@3 33:55@3 34:52@1 35:1@2 36:1@3 37:2@4 38:3@3 39:4@3 40:4@3
41:5@2 42:6@2 43:7@2 44:8@2 45:8@2 46:18@1 47:19@1 48:19@2 49:12@2 50:2@2
51:2@2 52:23@3 53:3@3 54:4@3 55:4@4 56:23@4 57:6@4 58:5@4 59:4@4 60:4@4
61:4@3 62:3@2 63:3@1 64:2@2 65:2@2 66:12@2 67:3@2 68:3@2 69:4@2 70:4@2
71:5@2 72:5@2 73:3@2 74:34@2 75:3@2 76:2@2 77:3@3 78:2@3 79:3@3 80:3@3
81:2@3 82:3@3 83:4@3 84:5@4 85:6@4 86:7@4 87:8@4 88:9@4 89:10@1 90:11@1
91:12@1 92:13@1 93:14@1 94:15@1 95:16@1 96:14@2 97:11@2 98:10@3 99:5@3 100:3@4"""


def scalar_samples(text=SCALAR):
    return [(float(t), {"x": float(v)}) for t, v in (s.split(":") for s in text.split())]


def hybrid_samples(text=HYBRID):
    out = []
    for s in text.split():
        time, rest = s.split(":")
        value, mode = rest.split("@")
        out.append((float(time), {"x": float(value), "label": int(mode)}))
    return out
