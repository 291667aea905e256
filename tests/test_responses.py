"""Numbered-field text and XML of the same channels give equal rows."""

from datetime import datetime

import pytest

from lithoscope.sources import models, responses

HEAD = """#
B050F03     Station:     {sta}
B050F16     Network:     IV
B052F03     Location:    {loc}
B052F04     Channel:     {cha}
B052F22     Start date:  {start}
B052F23     End date:    {end}
"""
STAGES = """#  Response (Poles and Zeros)
B053F03     Transfer function type:                A [Laplace Transform (Rad/sec)]
B053F04     Stage sequence number:                 1
B053F05     Response in units lookup:              M/S - Velocity
B053F07     A0 normalization factor:               +6.0E+07
B053F08     Normalization frequency:               1
B053F09     Number of zeros:                       2
B053F14     Number of poles:                       2
#  i  real  imag  real_error  imag_error
B053F10-13    0  +0.00000E+00  +0.00000E+00  +0.00000E+00  +0.00000E+00
B053F10-13    1  -1.50000E+01  +2.50000E+00  +0.00000E+00  +0.00000E+00
B053F15-18    0  -3.70000E-02  +3.70000E-02  +0.00000E+00  +0.00000E+00
B053F15-18    1  -3.70000E-02  -3.70000D-02  +0.00000E+00  +0.00000E+00

B058F03     Stage sequence number:                 1
B058F04     Gain:                                  1500
B058F05     Frequency of gain:                     1 HZ
B054F03     Transfer function type:                D
B054F04     Stage sequence number:                 2
B054F07     Number of numerators:                  2
B054F08-09    0 +1.0E+00 +0.0E+00
B054F08-09    1 +0.5E+00 +0.0E+00
B054F10     Number of denominators:                1
B054F11-12    0 -2.5E-01 +0.0E+00
B057F03     Stage sequence number:                 2
B057F04     Input sample rate:                     400
B057F05     Decimation factor:                     4
B061F03     Stage sequence number:                 3
B061F04     Response Name:                         half
B061F05     Symmetry Code:                         {symmetry}
B061F08     Number of numerators:                  3
B061F09       0 +1.0E-01
B061F09       1 +2.0E-01
B061F03     Stage sequence number:                 3
B061F09       2 +4.0E-01
B062F03     Transfer function type:                P
B062F04     Stage sequence number:                 4
B062F14     Number of coefficients:                2
B062F15-16    0 +3.0E+00 +0.0E+00
B062F15-16    1 -7.0E+00 +0.0E+00
B058F03     Stage sequence number:                 0
B058F04     Gain:                                  3.0E+09
"""
XML = """<?xml version="1.0"?><FDSNStationXML><Network code="IV"><Station code="ABC"><Channel code="HHZ" locationCode="00" startDate="2020-02-29T12:30:15.5" endDate="2021-12-31T00:00:00"><Response>
<Stage number="1"><PolesZeros><NormalizationFactor>6.0E7</NormalizationFactor><Zero number="0"><Real>0</Real><Imaginary>0</Imaginary></Zero><Zero number="1"><Real>-15</Real><Imaginary>2.5</Imaginary></Zero>
<Pole number="0"><Real>-0.037</Real><Imaginary>0.037</Imaginary></Pole><Pole number="1"><Real>-0.037</Real><Imaginary>-0.037</Imaginary></Pole></PolesZeros><StageGain><Value>1500</Value><Frequency>1</Frequency></StageGain></Stage>
<Stage number="2"><Coefficients><Numerator number="1">1.0</Numerator><Numerator>0.5</Numerator><Denominator>-0.25</Denominator></Coefficients><Decimation><InputSampleRate>400</InputSampleRate><Factor>4</Factor></Decimation></Stage>
<Stage number="3"><FIR><Symmetry>{symmetry}</Symmetry><NumeratorCoefficient i="1">0.1</NumeratorCoefficient><NumeratorCoefficient i="2">0.2</NumeratorCoefficient><NumeratorCoefficient i="3">0.4</NumeratorCoefficient></FIR></Stage>
<Stage number="4"><Polynomial><Coefficient number="0">3</Coefficient><Coefficient number="1">-7</Coefficient></Polynomial></Stage>
</Response></Channel></Station></Network></FDSNStationXML>"""


def resp(sta="ABC", loc="00", cha="HHZ", start="2020,060,12:30:15.5000", end="2021,365,00:00:00.0000", symmetry="A", stages=STAGES):
    return HEAD.format(sta=sta, loc=loc, cha=cha, start=start, end=end) + stages.format(symmetry=symmetry)


@pytest.mark.parametrize(("code", "name", "full"), [("A", "NONE", [0.1, 0.2, 0.4]), ("B", "ODD", [0.1, 0.2, 0.4, 0.2, 0.1]), ("C", "EVEN", [0.1, 0.2, 0.4, 0.4, 0.2, 0.1])])
def test_text_and_xml_agree(spark, tmp_path, code, name, full):
    (tmp_path / "a.resp").write_text(resp(symmetry=code))
    (tmp_path / "a.xml").write_text(XML.format(symmetry=name))
    text, xml = responses.read_resp(spark, str(tmp_path / "a.resp")), models.read_stationxml(spark, str(tmp_path / "a.xml"))
    assert text.columns == xml.columns
    got, want = (sorted(df.where("stage > 0").collect(), key=lambda r: r.stage) for df in (text, xml))
    assert got == want and [r.kind for r in got] == ["paz", "coefficients", "fir", "polynomial"]
    assert got[2].numerators == full and got[0].start == datetime(2020, 2, 29, 12, 30, 15, 500000)
    assert text.where("stage = 0").first().gain == 3e9


def test_many_epochs_and_odd_texts(spark, tmp_path):
    ended = resp(end="No Ending Time", loc="??")
    other = resp(sta="DEF", start="2000,001", stages="B058F03     Stage sequence number: 1\nB058F04     Gain: 2\n").replace("\n", "\r\n")
    bare = resp(sta="NIL", stages="# nothing\n") + resp(sta="NOC", cha="")
    (tmp_path / "b.resp").write_text("# comment first\n\n" + ended + other + bare + ended)
    (tmp_path / "empty.resp").write_text("")
    rows = responses.read_resp(spark, str(tmp_path)).collect()
    assert sorted({r.sid for r in rows}) == ["IV.ABC..HHZ", "IV.DEF.00.HHZ"] and len(rows) == 2 * 5 + 1
    assert all(r.end is None for r in rows if r.sid == "IV.ABC..HHZ")
    (one,) = [r for r in rows if r.sid == "IV.DEF.00.HHZ"]
    assert (one.stage, one.gain, one.kind, one.poles, one.start) == (1, 2.0, None, None, datetime(2000, 1, 1))
